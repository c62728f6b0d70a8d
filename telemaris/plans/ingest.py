"""Queries over exports: rows of the tables are written as the files that sources read, and read back.

Exports have what real ones have: broken lines, missing parts, odd numbers and times, names in two spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemaris.functions import classify, clean
from telemaris.operators import network, profile, structure
from telemaris.plans.registry import query
from telemaris.session import kept, shared_dir, table
from telemaris.sources import files, flows, host_events

# Host events. An event's kind is [1, 3, 8, 10, 11, 26][event_id % 6]; every 23rd line is cut short, every 29th has no computer.
KINDS = (1, 3, 8, 10, 11, 26)
GOOD = "event_id % 23 <> 0 AND event_id % 29 <> 0"


def _host_lines(spark: SparkSession, sf_dir: str) -> str:
    """Host events as compressed JSON lines with XML inside; the folder they were written to, once for all queries."""
    return kept(spark, "host-events", sf_dir, lambda folder: _write_host_lines(spark, sf_dir, folder))


def _write_host_lines(spark: SparkSession, sf_dir: str, folder: str) -> None:
    e = table(spark, sf_dir, "events")
    n, text = F.col("event_id"), lambda c: c.cast("string")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % 6 + 1).cast("int"))
    guid = lambda k: F.concat(F.lit(" {P"), text(k), F.lit("} "))
    spelled = F.when(kind == 8, "Guid").otherwise("GUID")
    data = lambda name, value: F.coalesce(F.concat(F.lit('<Data Name="'), name if not isinstance(name, str) else F.lit(name), F.lit('">'), value, F.lit("</Data>")), F.lit(""))
    fields = F.concat(
        data("UtcTime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        data("ProcessGuid", guid(n)),
        data("ProcessId", F.when(n % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit(" "), text(n % 1000), F.lit(".0")))),
        data("Image", F.concat(F.lit("C:\\Temp\\é"), text(n), F.lit(".exe"))),
        data("User", F.when(n % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("u"), text(F.col("user_id"))))),
        data("CommandLine", F.when(n % 3 != 0, F.concat(F.lit("run "), text(n % 10)))),
        data("ParentProcessGuid", guid(F.floor(n / 3))),
        data(F.concat(F.lit("SourceProcess"), spelled), guid(n)),
        data(F.concat(F.lit("TargetProcess"), spelled), guid(n + 1)),
        data("DestinationPort", F.concat(text(n % 70), F.lit(".0"))),
        data("TargetFilename", F.lit("C:\\Users\\x.txt")),
    )
    computer = F.when(n % 29 == 0, F.lit("")).otherwise(F.concat(F.lit("<Computer>HOST"), text(F.col("user_id") % 7), F.lit("</Computer>")))
    xml = F.concat(F.lit("<Event><System><EventID>"), text(kind), F.lit("</EventID>"), computer, F.lit("</System><EventData>"), fields, F.lit("</EventData></Event>"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@timestamp"), F.struct(xml.alias("original")).alias("event")))
    files.write_lines(e.select(F.when(n % 23 == 0, F.substring(line, 1, 60)).otherwise(line).alias("value")), folder)


def _host_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed events, rejects, bad lines)."""
    rows, bad = files.json_lines(spark, _host_lines(spark, sf_dir), "`@timestamp` string, event struct<original:string>")
    events, rejects = host_events.parsed(rows.select(F.col("event.original").alias("original")))
    return events, rejects, bad


KINDS_SQL = f"SELECT *, {list(KINDS)}[(event_id % 6 + 1)::INTEGER] AS id FROM events WHERE {GOOD}"


@query(
    "host_events_typed",
    f"""
    WITH k AS ({KINDS_SQL})
    SELECT id AS "EventID", 'HOST' || (user_id % 7) AS "Computer", CASE WHEN id <> 26 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "UtcTime",
           CASE WHEN id IN (1, 3, 11) THEN 'P' || event_id END AS "ProcessGuid", CASE WHEN id IN (1, 3, 11) AND event_id % 5 <> 0 THEN event_id % 1000 END AS "ProcessId",
           CASE WHEN id IN (1, 3, 11) THEN 'C:\\Temp\\' || event_id || '.exe' END AS "Image", CASE WHEN id IN (1, 3, 11) AND event_id % 4 <> 0 THEN 'u' || user_id END AS "User",
           CASE WHEN id = 1 AND event_id % 3 <> 0 THEN 'run ' || (event_id % 10) END AS "CommandLine", CASE WHEN id = 1 THEN 'P' || (event_id // 3) END AS "ParentProcessGuid",
           CASE WHEN id IN (8, 10) THEN 'P' || event_id END AS "SourceProcessGUID", CASE WHEN id IN (8, 10) THEN 'P' || (event_id + 1) END AS "TargetProcessGUID",
           CASE WHEN id = 3 THEN event_id % 70 END AS "DestinationPort", CASE WHEN id = 11 THEN 'C:\\Users\\x.txt' END AS "TargetFilename"
    FROM k
    """,
)
def host_events_typed(spark, sf_dir):
    """XML in JSON lines as a typed table: only the fields of each event's kind, GUIDs without braces, one spelling."""
    found = host_events.typed(_host_events(spark, sf_dir)[0])
    names = ("EventID", "Computer", "UtcTime", "ProcessGuid", "ProcessId", "Image", "User", "CommandLine", "ParentProcessGuid", "SourceProcessGUID", "TargetProcessGUID", "DestinationPort", "TargetFilename")
    return clean.clean_strings(found).select(*clean.require_columns(found, list(names)))


@query(
    "host_event_rejects",
    "SELECT 'bad line' AS kind, count(*) AS n FROM events WHERE event_id % 23 = 0 UNION ALL SELECT 'reject', count(*) FROM events WHERE event_id % 23 <> 0 AND event_id % 29 = 0",
)
def host_event_rejects(spark, sf_dir):
    """Lines that are no JSON, and events without a computer: kept apart and counted."""
    _, rejects, bad = _host_events(spark, sf_dir)
    return bad.agg(F.lit("bad line").alias("kind"), F.count("*").alias("n")).unionByName(rejects.agg(F.lit("reject").alias("kind"), F.count("*").alias("n")))


HAVE = """
    h AS (SELECT id, f.field, count(*) AS total, count(*) FILTER (WHERE f.field IN ('UtcTime', 'ProcessGuid', 'ProcessId', 'Image', 'ParentProcessGuid', 'SourceProcessGUID', 'TargetProcessGUID', 'DestinationPort', 'TargetFilename')
          OR (f.field = 'CommandLine' AND event_id % 3 <> 0) OR (f.field = 'User' AND event_id % 4 <> 0)) AS available FROM k JOIN f USING (id) GROUP BY 1, 2)
"""
EXPECTED = "f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i in KINDS if i in host_events.FIELDS for x in host_events.FIELDS[i]) + ") v(id, field)),"


@query("missing_event_fields", f'WITH k AS ({KINDS_SQL}), {EXPECTED} {HAVE} SELECT id AS "EventID", field, total - available AS missing, total, round(100.0 * (total - available) / total, 6) AS pct FROM h')
def missing_event_fields(spark, sf_dir):
    """Fields that a kind of event should have, and how many of its events lack them."""
    return host_events.missing_fields(_host_events(spark, sf_dir)[0]).withColumn("pct", F.round("pct", 6))


@query(
    "field_availability",
    f"""WITH k AS ({KINDS_SQL}), {EXPECTED} {HAVE}
    SELECT id AS "EventID", field, available, total, round(100.0 * available / total, 6) AS pct, CASE WHEN 100.0 * available / total > 95 THEN 'OK' WHEN 100.0 * available / total > 50 THEN 'warn' ELSE 'missing' END AS status FROM h""",
)
def field_availability(spark, sf_dir):
    return host_events.availability(_host_events(spark, sf_dir)[0]).withColumn("pct", F.round("pct", 6))


@query("event_names", "SELECT coalesce(CASE id WHEN 1 THEN 'Process Create' WHEN 3 THEN 'Network Connection' WHEN 8 THEN 'Create Remote Thread' WHEN 10 THEN 'Process Access' WHEN 11 THEN 'File Create' END, 'Unknown') AS description, count(*) AS n FROM (" + KINDS_SQL + ") GROUP BY 1")
def event_names(spark, sf_dir):
    """Events by the description of their kind, a lookup table of fixed size."""
    names = spark.createDataFrame(list(classify.EVENT_NAMES.items()), "id int, name string")
    return classify.with_names(_host_events(spark, sf_dir)[0], "EventID", names, "description").groupBy("description").agg(F.count("*").alias("n"))


@query(
    "event_fingerprints",
    f"""
    WITH k AS (SELECT id, ['UtcTime:present', 'ProcessGuid:present', 'ProcessId:present', 'Image:present', CASE WHEN event_id % 4 = 0 THEN 'User:null' ELSE 'User:present' END, 'ParentProcessGuid:present', 'DestinationPort:present', 'TargetFilename:present',
                           CASE WHEN id = 8 THEN 'SourceProcessGuid:present' ELSE 'SourceProcessGUID:present' END, CASE WHEN id = 8 THEN 'TargetProcessGuid:present' ELSE 'TargetProcessGUID:present' END]
                          || CASE WHEN event_id % 3 <> 0 THEN ['CommandLine:present'] ELSE [] END AS fields FROM ({KINDS_SQL}))
    SELECT md5(id || '|' || array_to_string(list_sort(fields), '|')) AS pattern, count(*) AS n FROM k GROUP BY 1
    """,
)
def event_fingerprints(spark, sf_dir):
    """How many events share each fingerprint of kind and fields present."""
    found = _host_events(spark, sf_dir)[0].select(structure.event_fingerprint("EventID", "fields").alias("pattern"))
    return found.groupBy("pattern").agg(F.count("*").alias("n"))


# Flows

FLOWS_SQL = "SELECT *, l_orderkey * 8 + l_linenumber AS n FROM lineitem"


def _flow_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow documents as compressed JSON lines, written once for all queries and read back by their schema."""
    folder = kept(spark, "flows", sf_dir, lambda folder: _write_flows(spark, sf_dir, folder))
    return files.json_lines(spark, folder, flows.SCHEMA)[0]


def _write_flows(spark: SparkSession, sf_dir: str, folder: str) -> None:
    x = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    some = F.col("l_linenumber") % 3 != 0
    process = F.when(some, F.struct(F.array(F.lit("a"), text("l_linenumber")).alias("args"), F.concat(F.lit("C:\\bin\\p"), text(F.col("l_partkey") % 9), F.lit(".exe")).alias("executable"), F.concat(F.lit("p"), text(F.col("l_partkey") % 9)).alias("name"), F.struct(F.col("l_orderkey").alias("pid")).alias("parent"), F.col("l_partkey").alias("pid")))
    doc = F.struct(
        F.when(F.col("n") % 11 == 0, F.lit("not a time")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("@timestamp"),
        F.struct(F.floor("l_extendedprice").cast("long").alias("bytes"), F.concat(F.element_at(F.array(*map(F.lit, ("10.0.0.", "8.8.8.", "239.1.1.", "224.0.0.", "172.40.1."))), (F.col("l_partkey") % 5 + 1).cast("int")), text(F.col("l_partkey") % 50)).alias("ip"), F.col("l_quantity").cast("long").alias("packets"), F.when(F.col("n") % 7 == 0, F.lit("none")).otherwise(F.concat(text(F.col("l_partkey") % 600), F.lit(".0"))).alias("port")).alias("destination"),
        F.struct(F.lit("flow").alias("action"), (F.col("n") * 40_000_000).alias("duration"), F.array(F.concat(F.lit("t"), text("l_linenumber")), F.lit("other")).alias("type")).alias("event"),
        F.struct(F.concat(F.lit("h"), text(F.col("l_suppkey") % 5)).alias("hostname"), F.array(F.lit("1.1.1.1"), F.lit("2.2.2.2")).alias("ip"), F.array(F.lit("aa"), F.lit("bb")).alias("mac"), F.struct(F.lit("windows").alias("platform")).alias("os")).alias("host"),
        F.struct(F.floor("l_extendedprice").cast("long").alias("bytes"), F.lit("tcp").alias("transport")).alias("network"),
        F.struct(F.struct(text("l_orderkey").alias("id")).alias("flow")).alias("network_traffic"),
        process.alias("process"),
        F.struct(F.concat(F.lit("10.1.0."), text(F.col("l_suppkey") % 250)).alias("ip"), F.col("l_linenumber").cast("long").alias("bytes")).alias("source"),
    )
    files.write_lines(x.select(F.to_json(doc).alias("value")), folder)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flat(_flow_docs(spark, sf_dir))


IP = "['10.0.0.', '8.8.8.', '239.1.1.', '224.0.0.', '172.40.1.'][(l_partkey % 5 + 1)::INTEGER] || (l_partkey % 50)"


@query(
    "flow_table",
    f"""
    SELECT CASE WHEN n % 11 <> 0 THEN epoch_us(l_shipdate) // 1000 END AS at, floor(l_extendedprice)::BIGINT AS destination_bytes, {IP} AS destination_ip, l_quantity::BIGINT AS destination_packets,
           CASE WHEN n % 7 <> 0 THEN l_partkey % 600 END AS destination_port, 0 AS destination_processes, n * 40000000 AS event_duration, 't' || l_linenumber AS event_type, 'h' || (l_suppkey % 5) AS host_hostname, '1.1.1.1,2.2.2.2' AS host_ip, 'aa' AS host_mac,
           'windows' AS host_os_platform, NULL::BIGINT AS network_packets, 'tcp' AS network_transport, l_orderkey::VARCHAR AS network_traffic_flow_id,
           CASE WHEN l_linenumber % 3 <> 0 THEN 'a,' || l_linenumber ELSE '' END AS process_args, CASE WHEN l_linenumber % 3 <> 0 THEN 'p' || (l_partkey % 9) END AS process_name,
           CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey END AS process_parent_pid, '10.1.0.' || (l_suppkey % 250) AS source_ip, NULL::VARCHAR AS source_process_name
    FROM ({FLOWS_SQL})
    """,
)
def flow_table(spark, sf_dir):
    """Nested flow documents as a flat table: first elements, lists that are never null, whole ports, lenient times."""
    found = _flows(spark, sf_dir)
    lists = {c: F.array_join(c, ",") for c in ("host_ip", "process_args")}
    return found.withColumns(lists).select(
        clean.epoch_ms("timestamp").alias("at"), "destination_bytes", "destination_ip", "destination_packets", "destination_port", F.size("destination_process").alias("destination_processes"), "event_duration", "event_type",
        "host_hostname", "host_ip", "host_mac", "host_os_platform", "network_packets", "network_transport", "network_traffic_flow_id", "process_args", "process_name", "process_parent_pid", "source_ip", "source_process_name",
    )


@query("process_network_use", f"SELECT 'p' || (l_partkey % 9) AS process_name, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS total_bytes, round(avg(floor(l_extendedprice)), 4) AS mean_bytes, count(*) AS flows, count(DISTINCT CASE WHEN n % 7 <> 0 THEN l_partkey % 600 END) AS ports FROM ({FLOWS_SQL}) WHERE l_linenumber % 3 <> 0 GROUP BY 1")
def process_network_use(spark, sf_dir):
    return network.process_use(_flows(spark, sf_dir), "process_name", "destination_bytes", "destination_port").withColumn("mean_bytes", F.round("mean_bytes", 4))


@query("external_destinations", f"SELECT {IP} AS destination_ip, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS total, count(*) AS n FROM lineitem WHERE l_partkey % 5 IN (1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def external_destinations(spark, sf_dir):
    """The ten external addresses that most bytes go to; 224.x is none, 239.x is."""
    return network.external_destinations(_flows(spark, sf_dir), "destination_ip", "destination_bytes")


@query("listed_ports", f"SELECT l_partkey % 600 AS destination_port, count(*) AS n FROM ({FLOWS_SQL}) WHERE n % 7 <> 0 AND l_partkey % 600 IN (80, 443, 135, 22, 8080) GROUP BY 1")
def listed_ports(spark, sf_dir):
    return network.listed_ports(_flows(spark, sf_dir), "destination_port", (80, 443, 135, 22, 8080))


@query("duration_classes", f"SELECT CASE WHEN s < 0.1 THEN 'very short' WHEN s < 1 THEN 'short' WHEN s < 60 THEN 'medium' ELSE 'long' END AS class, count(*) AS n, round(sum(s), 3) AS seconds, round(sum(kb), 4) AS kilobytes FROM (SELECT n * 40000000 / 1e9 AS s, floor(l_extendedprice) / 1024 AS kb FROM ({FLOWS_SQL})) GROUP BY 1")
def duration_classes(spark, sf_dir):
    rows = _flows(spark, sf_dir).select(clean.seconds("event_duration").alias("s"), clean.scaled_bytes("destination_bytes", "KB").alias("kb"))
    return rows.groupBy(classify.duration_class("s").alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("s"), 3).alias("seconds"), F.round(F.sum("kb"), 4).alias("kilobytes"))


@query("address_flags", f"SELECT ip, regexp_matches(ip, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\.0\\.0\\.1)') AS private, NOT regexp_matches(ip, '^(10\\.|192\\.168\\.|172\\.|224\\.)') AS external, count(*) AS n FROM (SELECT {IP} AS ip FROM lineitem) GROUP BY 1, 2, 3")
def address_flags(spark, sf_dir):
    rows = _flows(spark, sf_dir).select(F.col("destination_ip").alias("ip"))
    return rows.groupBy("ip", classify.is_private_ip("ip").alias("private"), classify.is_external_ip("ip").alias("external")).agg(F.count("*").alias("n"))


# Attack reports

TACTICS = "['discovery', 'execution', 'persistence'][(event_id % 3 + 1)::INTEGER]"
RULES = ((0, 9, "keep", None, None, 0), (10, 19, "capture", 'cmd="(.*)" in (\\w+)', "$2> $1", 0), (20, 29, "strip", "^powershell ", None, 0), (30, 34, "keep", None, None, 0), (30, 34, "strip", "^powershell ", None, 1))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report file of one JSON array: an entry for each 'error' event."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    tactic = F.element_at(F.array(*map(F.lit, ("discovery", "execution", "persistence"))), (F.col("event_id") % 3 + 1).cast("int"))
    n = F.col("event_id").cast("string")
    command = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('powershell "x" '), n)).otherwise(F.concat(F.lit('cmd="dir '), n, F.lit('" in temp')))
    meta = F.when(F.col("event_id") % 4 != 0, F.struct(tactic.alias("tactic"), F.when(F.col("event_id") % 5 != 0, F.lit("T1")).alias("technique_name")))
    entry = F.struct(F.col("event_id").alias("number"), iso.alias("delegated_timestamp"), F.when(F.col("event_id") % 3 == 0, F.lit("soon")).otherwise(iso).alias("collected_timestamp"), command.alias("command"), meta.alias("attack_metadata"))
    folder = shared_dir(spark, "report")
    whole = e.groupBy((F.floor(F.col("user_id") / 10)).alias("report")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # a report has some hundred entries
    whole.select(F.to_json("entries").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return files.json_array(spark, folder, f"number long, {flows.REPORT}")


@query(
    "report_entries",
    f"""
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry, CASE WHEN event_id % 2 = 0 THEN 'powershell "x" ' || event_id ELSE 'cmd="dir ' || event_id || '" in temp' END AS command,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS delegated_timestamp, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS collected_timestamp, NULL::VARCHAR AS finished_timestamp,
           CASE WHEN event_id % 4 <> 0 THEN {TACTICS} ELSE '' END AS tactic, CASE WHEN event_id % 4 <> 0 AND event_id % 5 <> 0 THEN 'T1' ELSE '' END AS technique_name, '' AS ability_name
    FROM events WHERE event_type = 'error'
    """,
)
def report_entries(spark, sf_dir):
    return flows.report_entries(_report(spark, sf_dir), "number")


@query(
    "rewritten_commands",
    """
    WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry, event_id, event_id % 2 = 0 AS shell FROM events WHERE event_type = 'error'),
         r AS (SELECT entry, event_id, shell, 0 AS position, CASE WHEN entry % 35 < 10 OR entry % 35 >= 30 THEN 'keep' WHEN entry % 35 < 20 THEN 'capture' ELSE 'strip' END AS kind FROM e
               UNION ALL SELECT entry, event_id, shell, 1, 'strip' FROM e WHERE entry % 35 >= 30),
         c AS (SELECT *, CASE WHEN shell THEN 'powershell "x" ' || event_id ELSE 'cmd="dir ' || event_id || '" in temp' END AS command FROM r)
    SELECT row_number() OVER (ORDER BY entry, position) - 1 AS new_entry, entry, CASE WHEN kind = 'capture' AND NOT shell THEN 'temp> dir ' || event_id WHEN kind = 'strip' AND shell THEN 'x ' || event_id ELSE command END AS new_command FROM c
    """,
)
def rewritten_commands(spark, sf_dir):
    """Commands by rules for ranges of entry numbers, repeated every 35: kept, captured, stripped, or split in two."""
    entries = flows.report_entries(_report(spark, sf_dir), "number")
    rules = spark.createDataFrame([(f"{a}-{b}", *rest) for a, b, *rest in RULES], "entries string, kind string, pattern string, template string, position int")
    rules = rules.withColumn("place", F.explode(clean.range_list("entries"))).drop("entries")
    numbers = entries.select("entry", (F.col("entry") % 35).cast("int").alias("place"))
    return flows.rewritten(entries, numbers.join(rules, "place").drop("place")).select("new_entry", "entry", "new_command")


# Times, paths and commands


@query(
    "times_and_arrays",
    """
    SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END AS human, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 END AS lenient,
           CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'a' || event_id || ',b' ELSE '' END AS listed, CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'a' || event_id END AS first
    FROM events
    """,
)
def times_and_arrays(spark, sf_dir):
    """Times as people write them, times or anything else, and values that may be a list, a scalar, null or nothing."""
    n = F.col("event_id")
    text = F.concat(F.lit("a"), n.cast("string"))
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 3 == 0, F.lit("yesterday")).otherwise(F.concat(F.date_format("ts", "MMM d, yyyy '@' HH:mm:ss.SSSSSS"), F.lit(" (UTC)"))).alias("human"),
        F.when(n % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.lit("?")).alias("lenient"),
        F.when(n % 4 == 0, F.to_json(F.struct(text.alias("v")))).when(n % 4 == 1, F.to_json(F.struct(F.array(text, F.lit("b")).alias("v")))).when(n % 4 == 2, F.lit('{"v": null}')).otherwise(F.lit("{}")).alias("json"),
    )
    listed = clean.wrapped(F.expr("try_variant_get(try_parse_json(json), '$.v', 'variant')"))
    return raw.select("event_id", clean.epoch_ms(clean.human_time("human")).alias("human"), clean.epoch_ms(clean.lenient_time("lenient")).alias("lenient"), F.array_join(listed, ",").alias("listed"), clean.first_element(listed).alias("first"))


PATH_SQL = "['C:\\Windows\\System32\\', 'C:\\Temp\\', 'D:\\home\\.cache\\', 'C:\\Users\\u\\AppData\\Local\\', ''][(p_partkey % 5 + 1)::INTEGER] || CASE WHEN p_partkey % 7 = 0 THEN '.hid' || p_partkey ELSE p_name END || ['.EXE', '.txt', '.ps1', '', '.dll' || repeat('x', 100)][(p_partkey % 4 + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END)::INTEGER]"


@query(
    "path_flags",
    f"""
    WITH p AS (SELECT p_partkey, {PATH_SQL} AS path FROM part)
    SELECT p_partkey, regexp_replace(path, '\\\\[^\\\\]*$', '') AS directory, nullif(lower(regexp_extract(path, '\\.([^.\\\\]+)$', 1)), '') AS extension, regexp_matches(path, '(?i)\\\\temp\\\\|\\\\tmp\\\\') AS in_temp,
           regexp_matches(path, '(?i)\\\\system32\\\\|\\\\windows\\\\') AS in_system, regexp_matches(path, '(?i)\\\\users\\\\|\\\\home\\\\') AS in_users, regexp_matches(path, '(?i)\\\\appdata\\\\') AS in_appdata,
           regexp_matches(path, '(?i)\\.(exe|dll|bat|cmd|ps1|vbs|scr)$') AS executable, regexp_matches(path, '\\\\\\.[^\\\\]+$') AS hidden, length(path) > 100 AS long_name, contains(path, ' ') AS has_space FROM p
    """,
)
def path_flags(spark, sf_dir):
    """Directory, extension, location and suspicious traits of Windows paths made from part names."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    path = F.concat(pick(("C:\\Windows\\System32\\", "C:\\Temp\\", "D:\\home\\.cache\\", "C:\\Users\\u\\AppData\\Local\\", ""), k % 5 + 1), F.when(k % 7 == 0, F.concat(F.lit(".hid"), k.cast("string"))).otherwise(F.col("p_name")), pick((".EXE", ".txt", ".ps1", "", ".dll" + "x" * 100), k % 4 + F.when(k % 11 == 0, 2).otherwise(1)))
    parts = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return parts.select("p_partkey", classify.directory("path").alias("directory"), classify.extension("path").alias("extension"), *(c.alias(n) for n, c in (classify.flags("path", classify.LOCATION_FLAGS) | classify.file_flags("path")).items()))


COMMAND_SQL = "['powershell -EncodedCommand ', 'C:\\Tools\\WGET http://x/', '  D:\\A B\\run.bat -ExecutionPolicy Bypass ', 'certutil base64 ', NULL, 'ls '][(p_partkey % 6 + 1)::INTEGER] || p_partkey"


@query(
    "command_flags",
    f"""
    WITH c AS (SELECT p_partkey, {COMMAND_SQL} AS command FROM part)
    SELECT CASE WHEN command IS NOT NULL THEN regexp_replace(lower(string_split_regex(trim(command), '\\s+')[1]), '.*\\\\', '') END AS base, coalesce(regexp_matches(command, '(?i)-EncodedCommand|-enc'), false) AS encoded,
           coalesce(regexp_matches(command, '(?i)-ExecutionPolicy Bypass'), false) AS policy_bypass, coalesce(regexp_matches(command, '(?i)base64|b64encode'), false) AS base64,
           coalesce(regexp_matches(command, '(?i)wget|curl|Invoke-WebRequest|DownloadFile'), false) AS download, coalesce(regexp_matches(command, '(?i)\\.ps1|\\.bat|\\.cmd|\\.vbs'), false) AS script, count(*) AS n FROM c GROUP BY ALL
    """,
)
def command_flags(spark, sf_dir):
    """Base command and the five suspicious traits of command lines."""
    starts = ("powershell -EncodedCommand ", "C:\\Tools\\WGET http://x/", "  D:\\A B\\run.bat -ExecutionPolicy Bypass ", "certutil base64 ", None, "ls ")
    command = F.concat(F.element_at(F.array(*map(F.lit, starts)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(command.alias("command"))
    traits = {n: c.alias(n) for n, c in classify.flags("command", classify.COMMAND_FLAGS).items()}
    return rows.groupBy(classify.base_command("command").alias("base"), *traits.values()).agg(F.count("*").alias("n"))


@query(
    "validity_flags",
    """
    WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'broken' ELSE substr(md5(event_id::VARCHAR), 1, 8) || '-0000-1111-2222-' || substr(md5(event_id::VARCHAR), 1, 12) END AS guid, event_id % 5 - 1 AS pid, event_id % 30 AS id, ts FROM events)
    SELECT event_id % 4 = 0 AS bad_guid, pid <= 0 AS bad_pid, id NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) AS bad_event_id, ts > TIMESTAMP '2024-01-20 00:00:00' AS in_future, count(*) AS n FROM e GROUP BY ALL
    """,
)
def validity_flags(spark, sf_dir):
    n = F.col("event_id")
    digest = F.md5(n.cast("string"))
    rows = table(spark, sf_dir, "events").select(F.when(n % 4 == 0, F.lit("broken")).otherwise(F.concat(F.lit("{"), F.left(digest, F.lit(8)), F.lit("-0000-1111-2222-"), F.left(digest, F.lit(12)), F.lit("}"))).alias("guid"), (n % 5 - 1).alias("pid"), (n % 30).alias("id"), "ts")
    found = classify.validity_flags("guid", "pid", "id", "ts", list(range(12)), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return rows.groupBy(*(c.alias(k) for k, c in found.items())).agg(F.count("*").alias("n"))


# Structure of documents


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of three shapes."""
    n = F.col("event_id")
    text = n.cast("string")
    a = F.concat(F.lit('{"id": '), text, F.lit(', "user": {"name": "u", "tags": ["x", "y"]}, "list": [{"k": 1}, {"z": 2}]}'))
    b = F.concat(F.lit('{"user": {"name": "v"}, "id": "'), text, F.lit('", "empty": ""}'))
    return table(spark, sf_dir, "events").select("event_id", F.when(n % 10 < 6, a).when(n % 10 < 9, b).otherwise(F.lit("[1")).alias("json"))


SHAPES = "s AS (SELECT count(*) FILTER (WHERE event_id % 10 < 6) AS a, count(*) FILTER (WHERE event_id % 10 BETWEEN 6 AND 8) AS b FROM events)"


@query("json_paths", f"WITH {SHAPES} SELECT unnest(['id', 'user', 'user.name', 'user.tags', 'list', 'list.k', 'empty']) AS path, unnest([a + b, a + b, a + b, a, a, a, b]) AS n FROM s")
def json_paths(spark, sf_dir):
    """Paths of nested documents two levels deep, of lists the first element's; documents that are no JSON have none."""
    return structure.paths(_nested(spark, sf_dir), "json", 2)


#: The structures of the two shapes, as the fingerprints spell them.
SHAPE_A = "OBJECT<id: BIGINT, list: ARRAY<OBJECT<k: BIGINT, z: BIGINT>>, user: OBJECT<name: STRING, tags: ARRAY<STRING>>>"
SHAPE_B = "OBJECT<empty: STRING, id: STRING, user: OBJECT<name: STRING>>"


@query("json_fingerprints", f"WITH {SHAPES} SELECT unnest([md5('{SHAPE_A}'), md5('{SHAPE_B}')]) AS pattern, unnest([a, b]) AS n, round(unnest([100.0 * a / (a + b), 100.0 * b / (a + b)]), 6)::DOUBLE AS pct, unnest([CASE WHEN a >= b THEN 1 ELSE 2 END, CASE WHEN a >= b THEN 2 ELSE 1 END])::INTEGER AS rank FROM s")
def json_fingerprints(spark, sf_dir):
    """Documents by the fingerprint of their keys and types: two shapes."""
    docs = _nested(spark, sf_dir).withColumn("pattern", structure.json_fingerprint("json")).where("pattern is not null")
    return structure.patterns(docs, "pattern").select("pattern", "n", F.round("pct", 6).alias("pct"), "rank")


@query(
    "pattern_classes",
    """
    WITH k AS (SELECT CASE WHEN event_id % 1000 < 520 THEN 'a' WHEN event_id % 1000 < 740 THEN 'b' WHEN event_id % 1000 < 860 THEN 'c' WHEN event_id % 1000 < 985 THEN 'd' || (event_id % 5) ELSE 'e' || (event_id % 3) END AS pattern FROM events),
         c AS (SELECT pattern, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM k) AS pct FROM k GROUP BY 1)
    SELECT pattern, n, round(pct, 6)::DOUBLE AS pct, row_number() OVER (ORDER BY n DESC, pattern)::INTEGER AS rank, round(sum(pct) OVER (ORDER BY n DESC, pattern), 6)::DOUBLE AS coverage,
           CASE WHEN pct >= 50 THEN 'PRIMARY' WHEN pct >= 20 THEN 'SECONDARY' WHEN pct >= 5 THEN 'VARIANT' WHEN pct >= 1 THEN 'RARE_VARIANT' ELSE 'OUTLIER' END AS class,
           CASE WHEN pct >= 5 THEN 'common' WHEN pct >= 1 THEN 'uncommon' ELSE 'rare' END AS frequency FROM c
    """,
)
def pattern_classes(spark, sf_dir):
    """Patterns in all five classes and three frequencies."""
    k = F.col("event_id") % 1000
    pattern = F.when(k < 520, "a").when(k < 740, "b").when(k < 860, "c").when(k < 985, F.concat(F.lit("d"), (F.col("event_id") % 5).cast("string"))).otherwise(F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")))
    out = structure.patterns(table(spark, sf_dir, "events").select(pattern.alias("pattern")), "pattern")
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("pct", "coverage")})


@query(
    "presence_kinds",
    """
    WITH f AS (SELECT event_id, unnest(['id'] || CASE WHEN event_id % 50 > 0 THEN ['name'] ELSE [] END || CASE WHEN event_id % 3 = 0 THEN ['note'] ELSE [] END || CASE WHEN event_id % 40 = 0 THEN ['odd'] ELSE [] END) AS field FROM events),
         c AS (SELECT field, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM events) AS pct FROM f GROUP BY 1)
    SELECT field, n, round(pct, 6)::DOUBLE AS pct, CASE WHEN pct >= 95 THEN 'always' WHEN pct < 5 THEN 'rare' ELSE 'conditional' END AS kind FROM c
    """,
)
def presence_kinds(spark, sf_dir):
    """Fields that all rows have, most, some and few."""
    n = F.col("event_id")
    fields = F.array(F.lit("id"), F.when(n % 50 > 0, "name"), F.when(n % 3 == 0, "note"), F.when(n % 40 == 0, "odd"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array_compact(fields)).alias("field"))
    return structure.presence(rows, "event_id", "field").withColumn("pct", F.round(F.col("pct").cast("double"), 6))


@query(
    "json_field_profile",
    f"""WITH {SHAPES}, i AS (SELECT count(DISTINCT event_id) AS ids, avg(length(event_id::VARCHAR)) AS mean FROM events WHERE event_id % 10 < 9)
    SELECT unnest(['id', 'user', 'list', 'empty']) AS field, unnest([a + b, a + b, a, b]) AS n, unnest([0.0, 0.0, 0.0, 100.0])::DOUBLE AS empty_pct, round(unnest([mean, (29.0 * a + 12.0 * b) / (a + b), 17.0, 0.0]), 6)::DOUBLE AS mean_length,
           unnest([ids, 2, 1, 1]) AS n_distinct, unnest([ids <= 20, true, true, true]) AS low_cardinality FROM s, i""",
)
def json_field_profile(spark, sf_dir):
    """Per field of JSON documents: rows, empty ones, mean length as text, different values, and whether those are few."""
    return structure.field_profile(_nested(spark, sf_dir), "json").withColumn("mean_length", F.round("mean_length", 6))


@query(
    "extraction_plan",
    f"""WITH {SHAPES} SELECT unnest([a, b]) AS n, unnest(['id,list', 'empty,id']) AS core, unnest(['empty', 'list']) AS lacking, unnest([CASE WHEN a >= (a + b) * 0.5 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN b >= (a + b) * 0.5 THEN 'HIGH' ELSE 'MEDIUM' END]) AS priority FROM s""",
)
def extraction_plan(spark, sf_dir):
    """Of each shape of document: wanted fields that it has, those that it lacks, and a priority by share."""
    docs = _nested(spark, sf_dir).withColumn("pattern", structure.json_fingerprint("json")).where("pattern is not null")
    fields = docs.groupBy("pattern").agg(F.first(F.expr("map_keys(cast(try_parse_json(json) as map<string,variant>))")).alias("fields"))
    plan = structure.extraction_plan(structure.patterns(docs, "pattern").join(fields, "pattern"), "fields", ["id", "list", "empty"])
    return plan.select("n", F.array_join("core", ",").alias("core"), F.array_join("lacking", ",").alias("lacking"), "priority")


# Trees of files


def _csv_tree(spark: SparkSession, sf_dir: str) -> str:
    """Two groups of CSV files with other headers in sub-folders, and files of another kind."""
    e = table(spark, sf_dir, "events").withColumn("note", F.array(F.lit("a,b"), F.col("event_type")))
    folder = shared_dir(spark, "tree")
    files.write_csv(e.where("event_id % 2 = 0").select("event_id", "user_id", "event_type", "note"), f"{folder}/dataset-7.part")
    files.write_csv(e.where("event_id % 2 = 1").select("event_type", "event_id", F.col("value").alias("a, b")), f"{folder}/deep/dataset-25.part")
    e.limit(10).select("event_id").write.json(f"{folder}/other")
    return folder


@query(
    "csv_tree",
    "SELECT event_id::VARCHAR AS event_id, event_type, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS user_id, CASE WHEN event_id % 2 = 0 THEN '[\"a,b\",\"' || event_type || '\"]' END AS note, CASE WHEN event_id % 2 = 1 THEN value END AS \"a, b\" FROM events",
)
def csv_tree(spark, sf_dir):
    """All CSV files of a tree as one table: wanted columns, missing ones null, quoted headers too."""
    found = files.csv_tree(spark, _csv_tree(spark, sf_dir), ["event_id", "event_type", "user_id", "note", "a, b"])
    return found.withColumn("a, b", F.col("`a, b`").cast("double")).drop("file_name")


@query(
    "csv_outcomes",
    "SELECT unnest(['binary', 'blank', 'empty', 'good']) AS kind, unnest(['rejected', 'rejected', 'rejected', 'read']) AS outcome, unnest(['no text', 'no header', 'empty', NULL]) AS reason, unnest([NULL, NULL, NULL, count(*)]) AS n, unnest([NULL, NULL, NULL, sum(event_id)::BIGINT]) AS ids FROM events",
)
def csv_outcomes(spark, sf_dir):
    """A tree with a file of bytes that are no text, a blank line and nothing: the rows of all others, and what became of each file."""
    folder, e = _csv_tree(spark, sf_dir), table(spark, sf_dir, "events").where("event_id = 0")
    e.select(F.concat(F.lit("PK\0\0"), "event_type")).coalesce(1).write.csv(f"{folder}/bad/binary")
    e.select(F.lit(" ")).coalesce(1).write.csv(f"{folder}/bad/blank", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    e.select(F.lit(None).cast("string")).coalesce(1).write.csv(f"{folder}/bad/empty", nullValue="")
    rows, outcomes = files.csv_tree_outcomes(spark, folder, ["event_id"])
    kind = F.coalesce(F.nullif(F.regexp_extract("file", "/bad/(\\w+)/", 1), F.lit("")), F.lit("good"))
    sums = rows.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"))
    return outcomes.select(kind.alias("kind"), "outcome", "reason").distinct().join(sums, "kind", "left")


@query("listed_files", "WITH k AS (SELECT event_type AS kind, sum(length(event_id::VARCHAR) + 1)::BIGINT AS length FROM events GROUP BY 1) SELECT kind, length, row_number() OVER (ORDER BY length, kind) = 1 AS picked FROM k")
def listed_files(spark, sf_dir):
    """Files of a tree by a keyword in their names, with their sizes, and the smallest as the trial input. Contents are not read."""
    e, folder = table(spark, sf_dir, "events"), shared_dir(spark, "listing")
    e.select("event_type", F.col("event_id").cast("string").alias("value")).coalesce(1).write.partitionBy("event_type").text(f"{folder}/a")
    e.limit(10).select("event_id").write.json(f"{folder}/b")
    found = files.listing(spark, folder, ["TXT"])
    kind = F.regexp_extract("path", "event_type=(\\w+)", 1)
    return found.join(files.smallest(found).select("path", F.lit(True).alias("least")), "path", "left").select(kind.alias("kind"), "length", F.coalesce("least", F.lit(False)).alias("picked"))


@query("typed_csv", "SELECT o_orderkey, o_totalprice, epoch_us(o_orderdate) // 1000 AS at FROM orders")
def typed_csv(spark, sf_dir):
    folder = shared_dir(spark, "orders")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), folder)
    return files.typed_csv(spark, folder, "o_orderkey long, o_totalprice double, o_orderdate timestamp").select("o_orderkey", "o_totalprice", clean.epoch_ms("o_orderdate").alias("at"))


@query("label_distribution", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY 1")
def label_distribution(spark, sf_dir):
    """The distribution of labels, written as CSV and read back."""
    folder = shared_dir(spark, "labels")
    files.write_csv(profile.share(table(spark, sf_dir, "events"), "event_type").withColumn("pct", F.round("pct", 6)), folder)
    return files.typed_csv(spark, folder, "event_type string, n long, pct double")


@query("run_metadata", "SELECT count(*) AS rows, 6::BIGINT AS columns, count(DISTINCT event_type) AS labels FROM events")
def run_metadata(spark, sf_dir):
    """A run's report of one row, written as JSON and read back."""
    e, folder = table(spark, sf_dir, "events"), shared_dir(spark, "run")
    files.write_report(e.agg(F.count("*").alias("rows"), F.lit(len(e.columns)).alias("columns"), F.count_distinct("event_type").alias("labels")), folder)
    return spark.read.schema("rows long, columns long, labels long").json(folder)


@query(
    "versioned_outputs",
    "SELECT source AS model, lang AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, count(*) AS n FROM documents WHERE doc_id % 4 <> 3 GROUP BY ALL UNION ALL SELECT source, lang, 'v3', 2 * count(*) FROM documents WHERE doc_id % 4 = 3 GROUP BY ALL",
)
def versioned_outputs(spark, sf_dir):
    """Outputs by model, dataset and version: a second write replaces the partitions it holds, no others."""
    d, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "versions")
    version = F.when(F.col("doc_id") % 4 == 3, "v3").when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2")
    counts = d.groupBy(F.col("source").alias("model"), F.col("lang").alias("dataset"), version.alias("version")).agg(F.count("*").alias("n"))
    files.write_versioned(counts, folder)
    files.write_versioned(counts.where("version = 'v3'").withColumn("n", F.col("n") * 2), folder)
    return spark.read.parquet(folder).select("model", "dataset", "version", "n")


@query("splits_on_disk", "SELECT CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 3 > 0 GROUP BY 1")
def splits_on_disk(spark, sf_dir):
    """Encoded rows, a partition for each split, of which two are read."""
    folder = shared_dir(spark, "splits")
    split = F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("doc_id") % 3 + 1).cast("int"))
    files.write_splits(table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("n_chars").cast("double")).alias("features"), split.alias("split")), folder)
    return spark.read.parquet(folder).where("split <> 'test'").groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("runs_to_do", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 5 = 0) GROUP BY 1")
def runs_to_do(spark, sf_dir):
    """Runs (users) without an output yet."""
    e = table(spark, sf_dir, "events")
    return files.to_do(e.groupBy("user_id").agg(F.count("*").alias("n")), e.where("event_type = 'error' and event_id % 5 = 0").select("user_id"), "user_id")


@query("run_log", "SELECT event_type AS kind, CASE WHEN user_id % 5 = 0 THEN 'failed' WHEN user_id % 3 = 0 THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n, sum(seconds)::DOUBLE AS seconds FROM (SELECT DISTINCT user_id, event_type, 2.0::DOUBLE AS seconds FROM events) GROUP BY 1, 2")
def run_log(spark, sf_dir):
    """A log of runs: all fail at first, then most are processed; the last status counts."""
    runs, folder = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("kind")).distinct(), shared_dir(spark, "log")
    files.log_runs(runs.select("run", "kind", F.lit("failed").alias("status"), F.lit(1.0).alias("seconds")), folder)
    status = F.when(F.col("run") % 5 == 0, "failed").when(F.col("run") % 3 == 0, "skipped").otherwise("processed")
    return files.log_runs(runs.select("run", "kind", status.alias("status"), F.lit(2.0).alias("seconds")), folder)


@query("metric_files", "SELECT source AS model, lang AS dataset, 'v' || (doc_id % 2 + 1) AS version, doc_id::DOUBLE AS roc_auc, CASE WHEN doc_id % 3 = 0 THEN n_chars::DOUBLE END AS f1_score FROM documents")
def metric_files(spark, sf_dir):
    """Metric files whose numbers stand at the top or under `performance`."""
    d, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "metrics")
    top = F.col("doc_id") % 3 == 0
    auc = F.col("doc_id").cast("double")
    name = F.struct(F.col("source").alias("model"), F.col("lang").alias("dataset"), F.concat(F.lit("v"), (F.col("doc_id") % 2 + 1).cast("string")).alias("version"), F.when(top, auc).alias("roc_auc"), F.when(top, F.col("n_chars").cast("double")).alias("f1_score"), F.when(~top, F.struct(auc.alias("roc_auc"))).alias("performance"))
    d.groupBy("source").agg(F.to_json(F.collect_list(name)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return files.metrics_files(spark, folder, ["roc_auc", "f1_score"])


@query("curve_files", "SELECT 'user' || user_id AS model, event_type AS dataset, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::INTEGER AS seq, event_id::DOUBLE AS x, value AS y FROM events")
def curve_files(spark, sf_dir):
    """Curves as arrays under one of two names, as points."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").cast("double").alias("x"), F.col("value").alias("y")))).alias("p"))
    even = F.col("user_id") % 2 == 0
    arrays = e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("model"), F.col("event_type").alias("dataset"), F.when(even, F.col("p.x")).alias("fpr"), F.when(~even, F.col("p.x")).alias("false_positive_rate"), F.when(even, F.col("p.y")).alias("tpr"), F.when(~even, F.col("p.y")).alias("true_positive_rate"))
    return files.curve_points(arrays, ["fpr", "false_positive_rate"], ["tpr", "true_positive_rate"])
