"""Queries over traffic, lineage, and attack correlation. lineitem stands in for flows, events for host events."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from telemaris.functions import classify
from telemaris.operators import correlate, network, ordered, profile
from telemaris.plans.registry import query
from telemaris.session import table


@query("top_talkers", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 10")
def top_talkers(spark, sf_dir):
    return network.top_by(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 10).withColumn("total", F.round("total", 2))


@query(
    "host_activity",
    """
    SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total_bytes, round(avg(l_extendedprice), 4) AS mean_bytes, sum(l_quantity) AS total_packets, count(*) AS n,
           arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS first_flag, arg_min(l_linestatus, (l_orderkey, l_linenumber)) AS first_status
    FROM lineitem GROUP BY 1
    """,
)
def host_activity(spark, sf_dir):
    order = F.struct("l_orderkey", "l_linenumber")
    out = network.host_activity(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity", {"first_flag": ("l_returnflag", order), "first_status": ("l_linestatus", order)})
    return out.withColumn("total_bytes", F.round("total_bytes", 2)).withColumn("mean_bytes", F.round("mean_bytes", 4))


@query("scan_suspects", "SELECT l_suppkey, count(DISTINCT l_partkey) AS ports, count(*) AS flows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 520")
def scan_suspects(spark, sf_dir):
    return network.scan_suspects(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 520)


@query("frequent_pairs", "SELECT l_suppkey, l_partkey, count(*) AS flows, round(avg(l_extendedprice), 4) AS mean_bytes FROM lineitem GROUP BY 1, 2 HAVING count(*) > 3")
def frequent_pairs(spark, sf_dir):
    return network.frequent_pairs(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_extendedprice", 3).withColumn("mean_bytes", F.round("mean_bytes", 4))


@query("exfiltration_hints", "SELECT l_suppkey, count(*) AS n FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.95) AS q FROM lineitem) WHERE l_extendedprice > q GROUP BY 1")
def exfiltration_hints(spark, sf_dir):
    return profile.above_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(
    "multi_record_flows",
    "SELECT count(*) AS flows, round(avg(n), 6) AS mean_records, max(n) AS most_records, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS multi_share FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
)
def multi_record_flows(spark, sf_dir):
    return network.multi_record(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("mean_records", F.round("mean_records", 6)).withColumn("multi_share", F.round("multi_share", 6))


@query("bytes_per_packet", "SELECT round(avg(CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END), 4) AS bytes_per_packet, round(avg(CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS large_share FROM lineitem")
def bytes_per_packet(spark, sf_dir):
    out = network.bytes_per_packet(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 50000)
    return out.select(F.round("bytes_per_packet", 4).alias("bytes_per_packet"), F.round("large_share", 6).alias("large_share"))


PORTS = "(l_partkey % 1100)::INTEGER"
SERVICES = "CASE " + " ".join(f"WHEN p = {k} THEN '{v}'" for k, v in classify.FLOW_SERVICES.items()) + " ELSE 'Unknown' END"


@query("port_services", f"SELECT {SERVICES} AS service, CASE WHEN p <= 1023 THEN 'well-known' WHEN p <= 49151 THEN 'registered' ELSE 'dynamic' END AS class, count(*) AS n FROM (SELECT {PORTS} AS p FROM lineitem) GROUP BY 1, 2")
def port_services(spark, sf_dir):
    ports = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1100).cast("int").alias("p"))
    return ports.groupBy(classify.named("p", classify.FLOW_SERVICES).alias("service"), classify.port_class("p").alias("class")).agg(F.count("*").alias("n"))


@query(
    "port_security",
    f"SELECT CASE WHEN p IN {classify.ENCRYPTED_PORTS} THEN 'encrypted' WHEN p IN {classify.CLEAR_PORTS} THEN 'clear' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT {PORTS} AS p FROM lineitem) GROUP BY 1",
)
def port_security(spark, sf_dir):
    return network.port_security(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1100).cast("int").alias("p")), "p")


@query(
    "address_classes",
    """
    WITH a AS (SELECT (CASE l_suppkey % 5 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '172.40.1.' WHEN 2 THEN '239.1.2.' WHEN 3 THEN '8.8.4.' ELSE '192.168.7.' END) || (l_suppkey % 256) AS s,
                      (CASE l_partkey % 4 WHEN 0 THEN '224.0.0.' WHEN 1 THEN '172.16.0.' WHEN 2 THEN '127.0.0.' ELSE '1.1.1.' END) || (l_partkey % 256) AS d FROM lineitem)
    SELECT CASE WHEN regexp_matches(s, '^(10\\.|192\\.168\\.|172\\.)') THEN 'Internal' WHEN regexp_matches(s, '^(224\\.|239\\.)') THEN 'Multicast' ELSE 'External' END AS source_class,
           CASE WHEN regexp_matches(d, '^(10\\.|192\\.168\\.|172\\.)') THEN 'Internal' WHEN regexp_matches(d, '^(224\\.|239\\.)') THEN 'Multicast' ELSE 'External' END AS destination_class, count(*) AS n
    FROM a GROUP BY 1, 2
    """.replace("\\\\", "\\"),
)
def address_classes(spark, sf_dir):
    def address(key, prefixes):
        pick = F.element_at(F.array(*map(F.lit, prefixes)), (F.col(key) % len(prefixes) + 1).cast("int"))
        return F.concat(pick, (F.col(key) % 256).cast("string"))

    rows = table(spark, sf_dir, "lineitem").select(address("l_suppkey", ("10.0.0.", "172.40.1.", "239.1.2.", "8.8.4.", "192.168.7.")).alias("s"), address("l_partkey", ("224.0.0.", "172.16.0.", "127.0.0.", "1.1.1.")).alias("d"))
    return network.directions(rows, "s", "d")


@query(
    "lineage_summary",
    "WITH f AS (SELECT o_custkey, count(*) AS children FROM orders GROUP BY 1) SELECT count(*) AS parents, round(avg(children), 6) AS mean, max(children) AS most, count(*) FILTER (WHERE children > 10) AS prolific FROM f",
)
def lineage_summary(spark, sf_dir):
    return network.fanout_summary(network.fanout(table(spark, sf_dir, "orders"), "o_custkey")).withColumn("mean", F.round("mean", 6))


@query("lineage_fanout", "SELECT o_custkey, count(*) AS children, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name, c_mktsegment")
def lineage_fanout(spark, sf_dir):
    fan = network.fanout(table(spark, sf_dir, "orders"), "o_custkey")
    return fan.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey", "left")


@query("orphans", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995) GROUP BY 1")
def orphans(spark, sf_dir):
    """Lines whose order is not among those of 1995."""
    parents = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1995)
    return network.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("id_reuse", "SELECT pairs, values, pairs / values AS ratio, pairs / values > 1.1 AS reused FROM (SELECT count(DISTINCT (l_orderkey, l_suppkey)) AS pairs, count(DISTINCT l_suppkey) AS values FROM lineitem)")
def id_reuse(spark, sf_dir):
    return network.reuse(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("first_last_activity", "SELECT user_id, min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels, count(*) AS n FROM events GROUP BY 1")
def first_last_activity(spark, sf_dir):
    return correlate.activity(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


def _entries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    entries = events.where("event_type = 'error'").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("entry_ts"), "user_id")
    return entries, events.select("event_id", F.col("ts").alias("event_ts"), "user_id")


PAIRS = """
    WITH n AS (SELECT event_id AS entry_id, epoch_us(ts) // 1000 AS entry_ms, user_id FROM events WHERE event_type = 'error'),
         p AS (SELECT n.entry_id, e.event_id, abs(epoch_us(e.ts) // 1000 - entry_ms) AS gap, entry_ms FROM n JOIN events e USING (user_id)
               WHERE abs(epoch_us(e.ts) // 1000 - entry_ms) <= 18000000 AND e.event_id <> n.entry_id),
         d AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY gap > 10800000, gap, event_id) AS r FROM p)
"""


@query("interval_match", PAIRS + "SELECT n.entry_id, n.user_id, d.event_id, d.gap FROM n LEFT JOIN d ON n.entry_id = d.entry_id AND d.r = 1")
def interval_match(spark, sf_dir):
    """The nearest other event of each error's user within three hours, else within five."""
    entries, events = _entries(spark, sf_dir)
    return correlate.detected(entries, events, "user_id", 10_800, 18_000, F.col("event_id") != F.col("entry_id")).select("entry_id", "user_id", "event_id", "gap")


@query("detection_rate", PAIRS + "SELECT count(*) AS entries, count(d.event_id) AS detected, count(d.event_id)::DOUBLE / count(*) AS rate FROM n LEFT JOIN d ON n.entry_id = d.entry_id AND d.r = 1")
def detection_rate(spark, sf_dir):
    entries, events = _entries(spark, sf_dir)
    return correlate.detection_rate(correlate.detected(entries, events, "user_id", 10_800, 18_000, F.col("event_id") != F.col("entry_id")))


@query(
    "label_events",
    PAIRS + """, h AS (SELECT event_id, arg_min('T' || (entry_id % 5), (entry_ms, 'T' || (entry_id % 5))) AS tactic FROM d WHERE r = 1 GROUP BY 1)
    SELECT e.event_id, coalesce(tactic, 'Normal') AS tactic FROM events e LEFT JOIN h USING (event_id)
    """,
)
def label_events(spark, sf_dir):
    entries, events = _entries(spark, sf_dir)
    hits = correlate.detected(entries, events, "user_id", 10_800, 18_000, F.col("event_id") != F.col("entry_id")).where("event_id is not null")
    hits = hits.select("event_id", "entry_ts", F.concat(F.lit("T"), (F.col("entry_id") % 5).cast("string")).alias("tactic"))
    return correlate.labeled(events.select("event_id"), hits, "tactic")


# Entries as commands: part of a command line or of an image in other letters, one of two characters, one found nowhere, none.
COMMANDS = """
    WITH e AS (SELECT event_id, ts, user_id % 4 AS host, event_id % 2 AS EventID, event_type, lower('C:\\Run\\' || event_type || '.exe /n ' || (event_id % 50) || ' /u ' || user_id) AS line,
                      CASE WHEN event_id % 7 > 0 THEN lower('C:\\Tools\\T' || (user_id % 30) || '.exe') END AS image FROM events),
         n AS (SELECT event_id AS entry_id, ts, host, EventID, lower(CASE event_id % 6 WHEN 0 THEN '/N ' || (event_id % 50) || ' /U' WHEN 1 THEN 'tools\\t' || (event_id % 40) || '.EXE' WHEN 2 THEN 'r' || (event_id % 10) WHEN 3 THEN 'nowhere.exe'
                      WHEN 4 THEN 'E' ELSE NULL END) AS command FROM e WHERE event_type = 'error'),
         p AS (SELECT entry_id, event_id, abs(epoch_us(e.ts) // 1000 - epoch_us(n.ts) // 1000) AS gap FROM n JOIN e USING (host, EventID)
               WHERE e.event_type <> 'error' AND abs(epoch_us(e.ts) // 1000 - epoch_us(n.ts) // 1000) <= 18000000 AND (contains(line, command) OR contains(image, command))),
         d AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY gap > 10800000, gap, event_id) AS r FROM p)
"""


@query("entry_matches", COMMANDS + "SELECT n.entry_id, d.event_id, d.gap FROM n LEFT JOIN d ON n.entry_id = d.entry_id AND d.r = 1")
def entry_matches(spark, sf_dir):
    """Each entry's nearest event of its host and code within three hours, else five, whose command line or image contains the entry's command."""
    n, text = F.col("event_id"), lambda c: c.cast("string")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("ts").alias("event_ts"), (F.col("user_id") % 4).alias("host"), (n % 2).alias("EventID"),
        F.concat(F.lit("C:\\Run\\"), "event_type", F.lit(".exe /n "), text(n % 50), F.lit(" /u "), text(F.col("user_id"))).alias("CommandLine"),
        F.when(n % 7 > 0, F.concat(F.lit("C:\\Tools\\T"), text(F.col("user_id") % 30), F.lit(".exe"))).alias("Image"),
    )
    command = F.when(n % 6 == 0, F.concat(F.lit("/N "), text(n % 50), F.lit(" /U"))).when(n % 6 == 1, F.concat(F.lit("tools\\t"), text(n % 40), F.lit(".EXE"))).when(n % 6 == 2, F.concat(F.lit("r"), text(n % 10)))
    command = command.when(n % 6 == 3, "nowhere.exe").when(n % 6 == 4, "E")
    entries = rows.where("event_type = 'error'").select(n.alias("entry_id"), F.col("event_ts").alias("entry_ts"), "host", "EventID", command.alias("command"))
    events = rows.where("event_type <> 'error'").drop("event_type")
    return correlate.nearest_containing(entries, events, "host", 18_000).select("entry_id", "event_id", "gap")  # one within three hours is nearer than any beyond


CAUSAL = """
    WITH RECURSIVE o AS (SELECT event_id, ts, user_id, event_type, lead(event_id) OVER w AS nxt, lead(ts) OVER w AS nts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         e AS (SELECT event_id AS parent, nxt AS child FROM o WHERE nxt IS NOT NULL AND epoch_us(nts) // 1000 - epoch_us(ts) // 1000 <= 18000000),
         t(root, node, depth) AS (SELECT event_id, event_id, 0 FROM events WHERE event_type = 'error' UNION ALL SELECT root, child, depth + 1 FROM t JOIN e ON node = parent WHERE depth < 10)
    SELECT root, node, min(depth)::INTEGER AS depth FROM t GROUP BY 1, 2
"""


def _followers(spark, sf_dir):
    """(seeds, edges): errors, and from each event of a user to the next one, if that comes within five hours."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    rows = ordered.overlapped(events, ["user_id"], ["ts", "event_id"], 1)
    w = W.partitionBy("user_id", "__block").orderBy("__place")
    pairs = rows.select("__own", F.lag("event_id").over(w).alias("parent"), F.col("event_id").alias("child"), F.lag("ts").over(w).alias("since"), F.col("ts").alias("event_ts")).where("__own")
    edges = pairs.where((F.unix_millis("event_ts") - F.unix_millis("since")) <= 18_000_000)
    return events.where("event_type = 'error'").select(F.col("event_id").alias("root"), F.col("event_id").alias("node"), F.col("ts").alias("since")), edges


@query("causal_trace", CAUSAL)
def causal_trace(spark, sf_dir):
    """What follows each error of a user, event by event with gaps of five hours at most, ten steps deep."""
    return correlate.traced(*_followers(spark, sf_dir), 10).select("root", "node", "depth")


@query("causal_lineage", CAUSAL)
def causal_lineage(spark, sf_dir):
    """causal_trace as one recursive query: an event has one follower, so paths are few."""
    return correlate.traced_recursively(*_followers(spark, sf_dir), 10).select("root", "node", "depth")


# Processes: every sixth event creates one, [1, 3, 8, 10, 11, 26][event_id % 6]; the events after it are its own or reach into another.
STEPS = 4
PROCESS = """
    k AS (SELECT *, event_id // 6 * 6 AS p FROM events),
    e AS (SELECT p AS parent, p AS child, event_id, ts FROM k WHERE event_id % 6 IN (0, 1, 4) UNION ALL SELECT event_id // 18 * 6, p, event_id, ts FROM k WHERE event_id % 6 = 0
          UNION ALL SELECT p, (event_id + 60) // 6 * 6, event_id, ts FROM k WHERE event_id % 6 IN (2, 3)),
    n0 AS (SELECT event_id AS root, event_id AS node, 0 AS depth, ts AS since FROM k WHERE event_id % 60 = 0)
"""
for _i in range(1, STEPS):
    _seen = " UNION ALL ".join(f"SELECT root, node FROM n{j}" for j in range(_i))
    PROCESS += f""", n{_i} AS (SELECT root, child AS node, {_i} AS depth, min(ts) AS since FROM n{_i - 1} JOIN e ON node = parent WHERE ts >= since AND child <> parent AND (root, child) NOT IN ({_seen}) GROUP BY 1, 2)"""
PROCESS += ", n AS (" + " UNION ALL ".join(f"SELECT * FROM n{j}" for j in range(STEPS)) + "), s AS (SELECT root, event_id, (min(depth) + 1)::INTEGER AS depth FROM n JOIN e ON node = parent WHERE ts >= since GROUP BY 1, 2)"


def _spawned(spark, sf_dir):
    """(root, event_id, depth): what every tenth created process leads to."""
    n = F.col("event_id")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    p = F.floor(n / 6) * 6
    kind = F.element_at(F.array(*map(F.lit, (1, 3, 8, 10, 11, 26))), (n % 6 + 1).cast("int"))
    own, reach = n % 6, (n % 6).isin(2, 3)
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("event_ts"), kind.alias("EventID"), F.when(own.isin(0, 1, 4), name(p)).alias("ProcessGuid"), F.when(own == 0, name(F.floor(n / 18) * 6)).alias("ParentProcessGuid"),
        F.when(reach, name(p)).alias("SourceProcessGUID"), F.when(reach, name(F.floor((n + 60) / 6) * 6)).alias("TargetProcessGUID"),
    )
    seeds = events.where(n % 60 == 0).select(n.alias("root"), F.col("ProcessGuid").alias("node"), F.col("event_ts").alias("since"))
    return correlate.traced_events(seeds, correlate.spawn_edges(events), STEPS)


@query("spawned_events", f"WITH {PROCESS} SELECT * FROM s")
def spawned_events(spark, sf_dir):
    """Events by root process: its own, those of processes it creates or reaches into, and so on, each once."""
    return _spawned(spark, sf_dir)


def _counts(spark, sf_dir):
    return _spawned(spark, sf_dir).groupBy("root").agg(F.count("*").alias("n"))


@query("spawned_stats", f"WITH {PROCESS}, c AS (SELECT root, count(*) AS n FROM s GROUP BY 1) SELECT sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (WHERE n > 15) AS many FROM c")
def spawned_stats(spark, sf_dir):
    return correlate.spawned_stats(_counts(spark, sf_dir), "n", 15).withColumn("mean", F.round("mean", 6))


@query("most_spawning", f"WITH {PROCESS} SELECT root, count(*)::BIGINT AS total, 1::BIGINT AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_spawning(spark, sf_dir):
    return network.top_by(_counts(spark, sf_dir), "root", "n", 10)


@query("spawned_by_host", f"WITH {PROCESS}, c AS (SELECT root, count(*) AS n FROM s GROUP BY 1) SELECT user_id % 5 AS host, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, count(*) AS entries FROM c JOIN events ON root = event_id GROUP BY 1")
def spawned_by_host(spark, sf_dir):
    hosts = table(spark, sf_dir, "events").select(F.col("event_id").alias("root"), (F.col("user_id") % 5).alias("host"))
    return correlate.spawned_by(_counts(spark, sf_dir).join(hosts, "root"), "host", "n").withColumn("mean", F.round("mean", 6))


@query("spawned_by_tactic", f"WITH {PROCESS}, c AS (SELECT root, count(*) AS n FROM s GROUP BY 1) SELECT event_type AS tactic, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, count(*) AS entries FROM c JOIN events ON root = event_id GROUP BY 1")
def spawned_by_tactic(spark, sf_dir):
    tactics = table(spark, sf_dir, "events").select(F.col("event_id").alias("root"), F.col("event_type").alias("tactic"))
    return correlate.spawned_by(_counts(spark, sf_dir).join(tactics, "root"), "tactic", "n").withColumn("mean", F.round("mean", 6))


@query("lateral_movement", f"WITH {PROCESS} SELECT a.user_id % 5 AS entry_host, b.user_id % 5 AS host, count(*) AS n FROM s JOIN events a ON root = a.event_id JOIN events b ON s.event_id = b.event_id WHERE a.user_id % 5 <> b.user_id % 5 GROUP BY 1, 2")
def lateral_movement(spark, sf_dir):
    """Spawned events on another host than their root's."""
    hosts = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("host"))
    rows = _spawned(spark, sf_dir).join(hosts, "event_id").join(hosts.select(F.col("event_id").alias("root"), F.col("host").alias("entry_host")), "root")
    return correlate.lateral(rows, "entry_host", "host")


@query(
    "phase_starts",
    "SELECT 'access' AS phase, min(epoch_us(ts) // 1000) AS first FROM events WHERE event_type = 'signup' UNION ALL SELECT 'attack', min(epoch_us(ts) // 1000) FROM events WHERE event_type = 'error' AND value > 50 UNION ALL SELECT 'never', NULL::BIGINT",
)
def phase_starts(spark, sf_dir):
    kind = F.col("event_type")
    return correlate.phase_starts(table(spark, sf_dir, "events"), "ts", {"access": kind == "signup", "attack": (kind == "error") & (F.col("value") > 50), "never": kind == "nothing"})


@query("tactic_durations", "SELECT event_type, min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last, count(*) AS n, ((max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 1000.0)::DOUBLE AS seconds FROM events GROUP BY 1 ORDER BY 2, 1")
def tactic_durations(spark, sf_dir):
    return correlate.durations(table(spark, sf_dir, "events"), "event_type", "ts").withColumn("seconds", F.col("seconds").cast("double"))


@query("active_periods", "SELECT epoch_ms(time_bucket(INTERVAL 10 MINUTE, ts)) AS start, count(*) FILTER (WHERE event_type = 'error') AS attacks, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def active_periods(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count_if(F.col("event_type") == "error").alias("attacks"), F.count("*").alias("n"))
    return counts.select(F.unix_millis("w.start").alias("start"), "attacks", "n").orderBy(F.desc("attacks"), "start").limit(10)
