"""Classes and flags of addresses, ports, durations, paths and commands, as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemaris.functions.clean import null_if_empty, of

# Fixed values.
FLOW_SERVICES = {53: "DNS", 80: "HTTP", 443: "HTTPS", 445: "SMB", 135: "RPC", 139: "NetBIOS", 389: "LDAP", 636: "LDAPS", 3389: "RDP", 9200: "Elasticsearch", 5355: "LLMNR", 1433: "SQL Server"}
HOST_SERVICES = {80: "HTTP", 443: "HTTPS", 53: "DNS", 21: "FTP", 22: "SSH", 25: "SMTP", 110: "POP3", 143: "IMAP", 993: "IMAPS", 995: "POP3S", 3389: "RDP", 445: "SMB", 135: "RPC", 139: "NetBIOS", 389: "LDAP"}
SUSPICIOUS_PORTS = (1337, 31337, 4444, 6666, 8080, 1234, 12345, 54321, 9999)
ENCRYPTED_PORTS = (443, 993, 995, 636, 22, 990)
CLEAR_PORTS = (80, 21, 23, 25, 53, 110, 143)
CAMPAIGNS = ((1, 20, "APT1"), (21, 30, "APT2"), (31, 38, "APT3"), (39, 44, "APT4"), (45, 47, "APT5"), (48, 50, "APT6"))
COMMAND_FLAGS = {
    "encoded": r"(?i)-EncodedCommand|-enc",
    "policy_bypass": r"(?i)-ExecutionPolicy Bypass",
    "base64": r"(?i)base64|b64encode",
    "download": r"(?i)wget|curl|Invoke-WebRequest|DownloadFile",
    "script": r"(?i)\.ps1|\.bat|\.cmd|\.vbs",
}
INTERNAL, MULTICAST = r"^(10\.|192\.168\.|172\.)", r"^(224\.|239\.)"
PRIVATE, NOT_EXTERNAL = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.0\.0\.1)", r"^(10\.|192\.168\.|172\.|224\.)"
EXECUTABLE, HIDDEN, LONG_NAME = r"(?i)\.(exe|dll|bat|cmd|ps1|vbs|scr)$", r"\\\.[^\\]+$", 100
EVENT_NAMES = {
    1: "Process Create",
    2: "File Creation Time",
    3: "Network Connection",
    4: "Sysmon State Change",
    5: "Process Terminate",
    6: "Driver Load",
    7: "Image Load",
    8: "Create Remote Thread",
    9: "Raw Access Read",
    10: "Process Access",
    11: "File Create",
    12: "Registry Event (Object create/delete)",
    13: "Registry Event (Value set)",
    14: "Registry Event (Key/Value rename)",
    15: "File Create Stream Hash",
    17: "Pipe Create",
    18: "Pipe Connect",
    19: "WMI Event Filter",
    20: "WMI Event Consumer",
    21: "WMI Event Consumer To Filter",
    22: "DNS Event",
    23: "File Delete",
    24: "Clipboard Change",
    25: "Process Tampering",
}
LOCATION_FLAGS = {
    "in_temp": r"(?i)\\temp\\|\\tmp\\",
    "in_system": r"(?i)\\system32\\|\\windows\\",
    "in_users": r"(?i)\\users\\|\\home\\",
    "in_appdata": r"(?i)\\appdata\\",
}


def ip_class(c: str | Column) -> Column:
    ip = of(c)
    return F.when(ip.isNull(), "Unknown").when(ip.rlike(INTERNAL), "Internal").when(ip.rlike(MULTICAST), "Multicast").otherwise("External")


def is_private_ip(c: str | Column) -> Column:
    return F.coalesce(of(c).rlike(PRIVATE), F.lit(False))


def is_external_ip(c: str | Column) -> Column:
    """Neither internal nor 224.x; 239.x counts as external here; null does not."""
    return F.coalesce(~of(c).rlike(NOT_EXTERNAL), F.lit(False))


def port_class(c: str | Column) -> Column:
    port = of(c)
    return F.when(port <= 1023, "well-known").when(port <= 49151, "registered").when(port > 49151, "dynamic")


def named(c: str | Column, names: dict[int, str], default: str = "Unknown") -> Column:
    """A small fixed table's name for a number."""
    pairs = [F.lit(x) for k, v in names.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[of(c).cast("int")], F.lit(default))


def with_names(df: DataFrame, key: str, names: DataFrame, out: str, default: str = "Unknown") -> DataFrame:
    """df with `out` from a lookup table (key, name); Spark broadcasts the table while it is small."""
    table = names.select(F.col(names.columns[0]).alias(key), F.col(names.columns[1]).alias(out))
    return df.join(table, key, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def duration_class(seconds: str | Column) -> Column:
    s = of(seconds)
    return F.when(s < 0.1, "very short").when(s < 1, "short").when(s < 60, "medium").when(s >= 60, "long")


def directory(path: str | Column) -> Column:
    return F.regexp_replace(of(path), r"\\[^\\]*$", "")


def base_command(command: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.get(F.split(F.trim(of(command)), r"\s+"), F.lit(0))), r".*\\", "")


def extension(path: str | Column) -> Column:
    return null_if_empty(F.lower(F.regexp_extract(of(path), r"\.([^.\\]+)$", 1)))


def flags(c: str | Column, patterns: dict[str, str]) -> dict[str, Column]:
    return {name: F.coalesce(of(c).rlike(pattern), F.lit(False)) for name, pattern in patterns.items()}


def file_flags(path: str | Column) -> dict[str, Column]:
    p = of(path)
    return {
        "executable": F.coalesce(p.rlike(EXECUTABLE), F.lit(False)),
        "hidden": F.coalesce(p.rlike(HIDDEN), F.lit(False)),
        "long_name": F.coalesce(F.length(p) > LONG_NAME, F.lit(False)),
        "has_space": F.coalesce(p.contains(" "), F.lit(False)),
    }


def validity_flags(guid: str, pid: str, event_id: str, ts: str, known_ids: list[int], now: Column) -> dict[str, Column]:
    """What is wrong with a row. Braces around a GUID are optional: cleaning takes them away. now: passed in, so reruns agree."""
    hexes = r"^\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}?$"
    return {
        "bad_guid": F.coalesce(~F.col(guid).rlike(hexes), F.lit(False)),
        "bad_pid": F.coalesce(F.col(pid) <= 0, F.lit(False)),
        "bad_event_id": F.coalesce(~F.col(event_id).isin(known_ids), F.lit(False)),
        "in_future": F.coalesce(F.col(ts) > now, F.lit(False)),
    }


def campaign(number: str | Column) -> Column:
    """The campaign that a data set number belongs to."""
    n, out = of(number), None
    for low, high, name in CAMPAIGNS:
        out = F.when(n.between(low, high), name) if out is None else out.when(n.between(low, high), name)
    return out.otherwise("UNKNOWN")


def file_campaign(name: str | Column) -> Column:
    return campaign(F.regexp_extract(of(name), r"dataset-(\d+)\.", 1).try_cast("int"))
