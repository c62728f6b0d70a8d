"""Host events: an XML document inside a JSON line, as one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemaris.functions.clean import clean_guid, clean_text, once, printable, safe_int

XML = "System struct<EventID:int,Computer:string>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"

# The fields of each event id.
FIELDS: dict[int, tuple[str, ...]] = {
    1: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "CommandLine", "CurrentDirectory", "User", "Hashes", "ParentProcessGuid", "ParentProcessId", "ParentImage", "ParentCommandLine"),
    2: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetFilename", "CreationUtcTime", "PreviousCreationUtcTime", "User"),
    3: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "User", "Protocol", "SourceIsIpv6", "SourceIp", "SourceHostname", "SourcePort", "SourcePortName", "DestinationIsIpv6", "DestinationIp", "DestinationHostname", "DestinationPort", "DestinationPortName"),
    5: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "User"),
    6: ("UtcTime", "ImageLoaded", "Hashes", "User"),
    7: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "ImageLoaded", "OriginalFileName", "Hashes", "User"),
    8: ("UtcTime", "SourceProcessGUID", "SourceProcessId", "SourceImage", "TargetProcessGUID", "TargetProcessId", "TargetImage", "NewThreadId", "SourceUser", "TargetUser"),
    9: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "Device", "User"),
    10: ("UtcTime", "SourceProcessGUID", "SourceProcessId", "SourceImage", "TargetProcessGUID", "TargetProcessId", "TargetImage", "SourceThreadId", "SourceUser", "TargetUser"),
    11: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetFilename", "CreationUtcTime", "User"),
    12: ("EventType", "UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetObject", "User"),
    13: ("EventType", "UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetObject", "User"),
    14: ("EventType", "UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetObject", "User"),
    15: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetFilename", "CreationUtcTime", "Hash", "User"),
    16: ("UtcTime", "Configuration", "ConfigurationFileHash", "User"),
    17: ("EventType", "UtcTime", "ProcessGuid", "ProcessId", "PipeName", "Image", "User"),
    18: ("EventType", "UtcTime", "ProcessGuid", "ProcessId", "PipeName", "Image", "User"),
    22: ("UtcTime", "ProcessGuid", "ProcessId", "Image", "QueryName", "QueryStatus", "QueryResults", "User"),
    23: ("UtcTime", "ProcessGuid", "ProcessId", "User", "Image", "TargetFilename", "Hashes"),
    24: ("UtcTime", "ProcessGuid", "ProcessId", "User", "Image", "Hashes"),
    25: ("UtcTime", "ProcessGuid", "ProcessId", "User", "Image"),
}
COLUMNS = tuple(dict.fromkeys(f for fields in FIELDS.values() for f in fields))


def parsed(raw: DataFrame, xml: str = "original") -> tuple[DataFrame, DataFrame]:
    """(events, rejects): EventID, Computer and a name -> text map; rows without one of the first two are rejects."""
    row = once(raw, F.from_xml(printable(xml), XML), "__xml")
    pairs = F.transform(F.filter(F.coalesce(F.col("__xml.EventData.Data"), F.array()), lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"], d["_VALUE"]))
    # A name that stands twice keeps its last value.
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["_Name"]), F.map_from_arrays(F.array(p["_Name"]), F.array(p["_VALUE"]))))
    names = F.transform(pairs, lambda p: p["_Name"])
    fields = F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_entries(pairs)).otherwise(last)
    sound = F.col("__xml.System.EventID").isNotNull() & F.col("__xml.System.Computer").isNotNull()
    events = once(row.where(sound), fields, "fields").select(F.col("__xml.System.EventID").alias("EventID"), F.col("__xml.System.Computer").alias("Computer"), "fields")
    return events, row.where(~sound).select(raw.columns)


def typed(events: DataFrame) -> DataFrame:
    """One column for each field that any event id has, null where the row's id does not have it.

    Event 8 spells two fields ...Guid; they land in the ...GUID columns.
    """
    out = {}
    for name in COLUMNS:
        ids = [i for i, fields in FIELDS.items() if name in fields]
        value = F.col("fields")[name]
        if name.endswith("ProcessGUID"):
            value = F.when(F.col("EventID") == 8, F.coalesce(F.col("fields")[name.replace("GUID", "Guid")], value)).otherwise(value)
        if "Guid" in name or "GUID" in name:
            value = clean_guid(value)
        elif name.endswith(("ProcessId", "ThreadId", "Port")) and name != "NewThreadId":
            value = safe_int(value)
        else:
            value = clean_text(value)
        out[name] = F.when(F.col("EventID").isin(ids), value)
    return events.select("EventID", "Computer", *(v.alias(k) for k, v in out.items()))


def missing_fields(events: DataFrame) -> DataFrame:
    """(EventID, field, missing, total, pct): fields that an id should have, and how many of its rows don't."""
    table = F.create_map(*[x for i, fields in FIELDS.items() for x in (F.lit(i), F.array(*map(F.lit, fields)))])
    each = events.select("EventID", "fields", F.explode(table[F.col("EventID")]).alias("field"))
    have = F.coalesce(F.col("fields")[F.col("field")], F.when(F.col("EventID") == 8, F.col("fields")[F.replace("field", F.lit("GUID"), F.lit("Guid"))]))
    counts = each.groupBy("EventID", "field").agg(F.count_if(have.isNull()).alias("missing"), F.count("*").alias("total"))
    return counts.withColumn("pct", F.lit(100.0) * F.col("missing") / F.col("total"))


def availability(events: DataFrame) -> DataFrame:
    """(EventID, field, available, total, pct, status) of expected fields: OK above 95 %, warn above 50 %, else missing."""
    pct = F.lit(100.0) * (F.col("total") - F.col("missing")) / F.col("total")
    rows = missing_fields(events).select("EventID", "field", (F.col("total") - F.col("missing")).alias("available"), "total", pct.alias("pct"))
    return rows.withColumn("status", F.when(F.col("pct") > 95, "OK").when(F.col("pct") > 50, "warn").otherwise("missing"))
