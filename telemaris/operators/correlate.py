"""Attack entries and events: detection in time windows, spawned events, labels.

The engine behind these has no published source, so what is assumed stands in each docstring, and windows,
masks and depth are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemaris.session import setting, written


def within(entries: DataFrame, events: DataFrame, host: str, seconds: int, condition: Column | None = None) -> DataFrame:
    """Pairs of an entry and an event on one host, at most `seconds` apart: (entry_id, event_id, gap in ms).

    Time is cut into buckets of the window's width; an entry meets the events of its own bucket and of both
    neighbours by an equi-join, and the exact bound is checked there. Each pair meets once.
    entries: entry_id, entry_ts, host. events: event_id, event_ts, host.
    """
    width = seconds * 1000
    cut = lambda ts: F.floor(F.unix_millis(ts) / width)
    left = entries.withColumn("bucket", F.explode(F.array(*(cut("entry_ts") + i for i in (-1, 0, 1)))))
    right = events.withColumn("bucket", cut("event_ts"))
    gap = F.abs(F.unix_millis("event_ts") - F.unix_millis("entry_ts"))
    both = left.join(right, [host, "bucket"]).withColumn("gap", gap).where(F.col("gap") <= width)
    return (both.where(condition) if condition is not None else both).drop("bucket")


def detected(entries: DataFrame, events: DataFrame, host: str, seconds: int = 180, fallback: int = 300, condition: Column | None = None) -> DataFrame:
    """The event of each entry: nearest within `seconds`, else within `fallback`; the lower id on ties; null if there is none."""
    return nearest(entries, within(entries, events, host, fallback, condition), seconds)


def nearest(entries: DataFrame, pairs: DataFrame, seconds: int) -> DataFrame:
    """entries with the event_id and gap of their nearest pair, one within `seconds` before any other; null if there is none."""
    picked = pairs.groupBy("entry_id").agg(F.min(F.struct((F.col("gap") > seconds * 1000).alias("late"), "gap", "event_id")).alias("hit"))
    return entries.join(picked, "entry_id", "left").select(*entries.columns, F.col("hit.event_id").alias("event_id"), F.col("hit.gap").alias("gap"))


#: Bins of character runs; their set is 512 numbers of 64 bits.
BINS = 32_768


def _runs(text: Column, size: int) -> Column:
    """All runs of `size` characters of a text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _bin(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BINS)).cast("int")


def _bins_of(df: DataFrame, *keys: str | Column) -> list[int]:
    """The bins that df's keys have: BINS at most, however many rows there are."""
    return [r[0] for r in df.select(_bin(*keys).alias("bin")).distinct().collect()]


def _among(bins: list[int], *keys: str | Column) -> Column:
    """Whether the keys' bin is among some bins, as bits of a constant array."""
    words = [0] * (BINS // 64)
    for b in bins:
        words[b // 64] |= 1 << (b % 64)
    packed = F.expr("array(" + ",".join(f"{w - (1 << 64) if w >> 63 else w}L" if w != 1 << 63 else "bigint(-9223372036854775808)" for w in words) + ")")
    return F.getbit(F.get(packed, F.floor(_bin(*keys) / 64).cast("int")), _bin(*keys) % 64) == 1


def _cut(ts: str | Column, seconds: int) -> Column:
    """The number of a time's bucket."""
    return F.floor(F.unix_millis(ts) / (seconds * 1000))


def _in_reach(df: DataFrame, seconds: int) -> DataFrame:
    """Entries with the bucket of their time, and once more with each of its neighbours."""
    return df.withColumn("bucket", F.explode(F.array(*(_cut("entry_ts", seconds) + i for i in (-1, 0, 1)))))


def _spelled(events: DataFrame, wanted: DataFrame, commands: DataFrame, host: str, code: str, seconds: int, texts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(events, commands by run): events of the wanted entries' hosts, codes and times (by bins) with the runs of their texts in `__runs`; commands with each of theirs."""
    size = F.least(F.length("__command"), F.lit(3))
    sizes = sorted(r[0] for r in commands.select(size.alias("size")).distinct().collect()) or [3]  # 1 to 3
    each = commands.withColumn("__run", F.explode(F.coalesce(*(F.when(size == k, _runs(F.col("__command"), k)) for k in sizes))))
    text = F.lower(F.concat_ws("\n", *texts))
    near = events.withColumn("bucket", _cut("event_ts", seconds)).where(_among(_bins_of(_in_reach(wanted, seconds), host, code, "bucket"), host, code, "bucket"))
    return near.withColumn("__runs", F.concat(*(_runs(text, k) for k in sizes))), each


def _rarest(spelled: DataFrame, each: DataFrame, key: str) -> DataFrame:
    """(key, __run): of each command that run whose bin is rarest in the events; one that no event has comes first."""
    counts = spelled.select(F.explode("__runs").alias("__run")).where(_among(_bins_of(each, "__run"), "__run")).groupBy(_bin("__run").alias("__bin")).agg(F.count("*").alias("__n"))  # BINS rows at most
    counted = each.withColumn("__bin", _bin("__run")).join(F.broadcast(counts), "__bin", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return counted.groupBy(key).agg(F.min(F.struct("__n", "__run")).alias("__rarest")).select(key, "__rarest.__run")


def _by_run(spelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events by the runs that are wanted (by bins), each once."""
    return spelled.withColumn("__run", F.explode(F.array_distinct("__runs"))).drop("__runs").where(_among(_bins_of(wanted, "__run"), "__run"))


def _inside(texts: tuple[str, ...]) -> Column:
    """Whether one of the texts contains the command."""
    inside = F.lit(False)
    for t in texts:
        inside = inside | F.coalesce(F.contains(F.lower(t), F.col("__command")), F.lit(False))
    return inside


def containing(entries: DataFrame, events: DataFrame, host: str, seconds: int, command: str = "command", texts: tuple[str, ...] = ("CommandLine", "Image"), code: str = "EventID") -> DataFrame:
    """Pairs as of within(), of one event code too, where one of the event's texts contains the entry's command, whatever the case.

    Each entry is looked for by that run of three characters of its command which is rarest in the events of entries' hosts,
    codes and times (by bins of runs, so that what counts and chosen bins take is bounded): host, code, time bucket and that run are the join's keys, and the exact test
    follows. No pair is made by host and time alone, so a host with most of the events, or a common word in each command, does
    no harm. Commands of one or two characters are their own run. A null or empty command is in no event.
    entries: entry_id, entry_ts, host, code, command. events: event_id (different in each row), event_ts, host, code, texts.
    """
    wanted = entries.where(F.length(command) > 0).withColumn("__command", F.lower(command))
    spelled, each = _spelled(events, wanted, wanted.select("entry_id", "__command"), host, code, seconds, texts)
    keyed = written(wanted.join(_rarest(spelled, each, "entry_id"), "entry_id"), "entries")
    left = _in_reach(keyed, seconds)
    right = _by_run(spelled, keyed)
    gap = F.abs(F.unix_millis("event_ts") - F.unix_millis("entry_ts"))
    return left.join(right, [host, code, "bucket", "__run"]).withColumn("gap", gap).where((F.col("gap") <= seconds * 1000) & _inside(texts)).drop("bucket", "__run", "__command")


def nearest_containing(entries: DataFrame, events: DataFrame, host: str, seconds: int, command: str = "command", texts: tuple[str, ...] = ("CommandLine", "Image"), code: str = "EventID") -> DataFrame:
    """entries with the event_id and gap of the nearest pair of containing(), the lower id on ties; null if there is none.

    Entries of a command, host and time bucket may have very many events in common, so no such pairs are made: events meet different
    commands, by the keys of containing(), and of each command, host, code and bucket events and entries are gone through in the
    order of time, once each way. So rows grow with the events and the commands that each contains, not with pairs.
    """
    wanted = entries.where(F.length(command) > 0).select("entry_id", "entry_ts", host, code, F.lower(command).alias("__command"))
    names = written(wanted.select("__command").distinct().select(F.monotonically_increasing_id().alias("__name"), "__command"), "commands")  # a number that is written stays
    spelled, each = _spelled(events, wanted, names, host, code, seconds, texts)
    runs = written(names.join(_rarest(spelled, each, "__name"), "__name"), "runs")
    asked = _in_reach(wanted.join(names, "__command").drop("__command"), seconds)
    group = [host, code, "bucket", "__name"]
    keys = written(asked.select(*group).distinct().join(runs, "__name"), "keys")
    met = keys.join(_by_run(spelled, runs), [host, code, "bucket", "__run"]).where(_inside(texts))
    at = F.unix_millis("ts").alias("__at")
    met = met.withColumnRenamed("event_ts", "ts").select(*group, at, "event_id", F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"))
    points = met.unionByName(asked.withColumnRenamed("entry_ts", "ts").select(*group, at, "entry_id"), allowMissingColumns=True)
    hit = F.when(F.col("event_id").isNotNull(), F.struct("__at", "event_id"))
    # Events stand before entries of the same time, and the one of the lowest id last among those: it is what an entry finds.
    ways = [W.partitionBy(*group).orderBy(t, F.desc_nulls_last("event_id")).rowsBetween(W.unboundedPreceding, W.currentRow) for t in (F.asc("__at"), F.desc("__at"))]
    ends = [F.last(hit, ignorenulls=True).over(w) for w in ways]
    found = points.select("entry_id", "__at", *(x.alias(f"__x{i}") for i, x in enumerate(ends))).where("entry_id is not null")
    gaps = [F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(x)["__at"] - F.col("__at")).alias("gap"), F.col(x)["event_id"].alias("event_id"))) for x in ("__x0", "__x1")]
    best = found.select("entry_id", F.least(*gaps).alias("hit")).where(F.col("hit.gap") <= seconds * 1000).groupBy("entry_id").agg(F.min("hit").alias("hit"))
    return entries.join(best, "entry_id", "left").select(*entries.columns, F.col("hit.event_id").alias("event_id"), F.col("hit.gap").alias("gap"))


def spawn_edges(events: DataFrame) -> DataFrame:
    """(parent, child, event_id, event_ts): what one process's activity leads to, by three masks.

    A process's own events (child = parent), processes it creates (event 1), processes it reaches into (8, 10).
    events: EventID, event_id, event_ts, ProcessGuid, ParentProcessGuid, SourceProcessGUID, TargetProcessGUID.
    """
    own = events.where(F.col("ProcessGuid").isNotNull()).select(F.col("ProcessGuid").alias("parent"), F.col("ProcessGuid").alias("child"), "event_id", "event_ts")
    made = events.where((F.col("EventID") == 1) & F.col("ParentProcessGuid").isNotNull()).select(F.col("ParentProcessGuid").alias("parent"), F.col("ProcessGuid").alias("child"), "event_id", "event_ts")
    reached = events.where(F.col("EventID").isin(8, 10) & F.col("SourceProcessGUID").isNotNull()).select(F.col("SourceProcessGUID").alias("parent"), F.col("TargetProcessGUID").alias("child"), "event_id", "event_ts")
    return own.unionByName(made).unionByName(reached)


def traced(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(root, node, depth, since): what edges reach from the seeds, each node once at its least depth, then its earliest time.

    An edge counts from a node if it is no earlier than the node was reached. Breadth first, `depth` steps at most; each
    step's frontier is written to the shared folder, so plans stay short and cycles end.
    A frontier that is small goes to the edges' tasks, as AQE measures it; a large one is joined by node, and a parent with many
    edges is split there. seeds: root, node, since. edges: parent, child, event_ts; they are written once, as every step reads them.
    """
    edges = written(edges.where("parent is not null and child is not null and child != parent").select("parent", "child", "event_ts"), "edges")
    seen = written(seeds.select("root", "node", F.lit(0).alias("depth"), "since"), "trace")
    frontier = seen
    for step in range(1, depth + 1):
        reach = frontier.join(edges, F.col("node") == F.col("parent")).where("event_ts >= since")
        new = reach.groupBy("root", F.col("child").alias("node")).agg(F.min("event_ts").alias("since"))
        new = new.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(step).alias("depth"), "since")
        frontier = written(new, "trace")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traced_recursively(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(root, node, depth, since) as of traced(), as one recursive query that Spark plans and runs as a whole.

    Each path is a row, and cycles end because no path meets a node twice; so it is for lineages, where a node has few parents
    and children. Edges are written once, as every step reads them, and so is the result, as Spark's limit on a recursion's rows
    (a million, below the seeds alone of a large table) is lifted for this query only. Nothing is written between steps: a lost
    executor repeats them. Where a node is reached late at its least depth and earlier by a longer path, this follows both,
    traced() the first; with edges of one time, or one way to each node, both give the same.
    """
    links = written(edges.where("parent is not null and child is not null").select("parent", "child", "event_ts"), "edges")
    starts = seeds.select("root", "node", "since")
    found = seeds.sparkSession.sql(
        f"""
        WITH RECURSIVE t(root, node, depth, since, path) MAX RECURSION LEVEL {depth + 1} AS (
            SELECT root, node, 0, since, array(node) FROM {{starts}} UNION ALL
            SELECT t.root, e.child, t.depth + 1, e.event_ts, array_append(t.path, e.child) FROM t JOIN {{links}} e ON t.node = e.parent
            WHERE t.depth < {depth} AND e.event_ts >= t.since AND NOT array_contains(t.path, e.child))
        SELECT root, node, depth, since FROM t
        """,
        starts=starts,
        links=links,
    )
    best = found.groupBy("root", "node").agg(F.min(F.struct("depth", "since")).alias("x"))
    with setting(seeds.sparkSession, "spark.sql.cteRecursionRowLimit", "-1"):
        return written(best.select("root", "node", "x.depth", "x.since"), "lineage")


def traced_events(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(root, event_id, depth): what the seeds' processes and those that they lead to do, each event once at its least depth.

    A process reached in step d has its own events, and those that lead on, at depth d + 1; none is earlier than the process was
    reached. seeds: root, node, since. edges: parent, child, event_id, event_ts.
    """
    nodes = traced(seeds, edges, depth - 1)
    hits = nodes.join(edges, F.col("node") == F.col("parent")).where("event_ts >= since")
    return hits.groupBy("root", "event_id").agg((F.min("depth") + 1).cast("int").alias("depth"))


def spawned_by(spawned: DataFrame, key: str, n: str) -> DataFrame:
    """(key, total, mean, entries): what entries spawned, by their host or tactic."""
    return spawned.groupBy(key).agg(F.sum(n).alias("total"), F.avg(n).alias("mean"), F.count("*").alias("entries"))


def phase_starts(events: DataFrame, ts: str, phases: dict[str, Column]) -> DataFrame:
    """(phase, first): the earliest time, in epoch ms, at which each phase's condition holds; null if never."""
    row = events.agg(*(F.unix_millis(F.min(F.when(c, F.col(ts)))).alias(name) for name, c in phases.items()))
    return row.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("phase"), F.col(n).alias("first")) for n in phases))).alias("i", "x")).select("x.*")


def lateral(spawned: DataFrame, entry_host: str, host: str) -> DataFrame:
    """(entry host, host, n): events of an entry on other hosts than its own."""
    return spawned.where(F.col(host) != F.col(entry_host)).groupBy(entry_host, host).agg(F.count("*").alias("n"))


def labeled(events: DataFrame, hits: DataFrame, label: str, normal: str = "Normal") -> DataFrame:
    """events with the label of their earliest entry, else `normal`. hits: event_id, entry_ts, label."""
    first = hits.groupBy("event_id").agg(F.min_by(label, F.struct("entry_ts", label)).alias(label))
    return events.join(first, "event_id", "left").withColumn(label, F.coalesce(label, F.lit(normal)))


def detection_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("entries"), F.count("event_id").alias("detected"), F.avg(F.col("event_id").isNotNull().cast("double")).alias("rate"))


def spawned_stats(spawned: DataFrame, n: str, many: int = 100) -> DataFrame:
    """One row over entries' spawned counts."""
    return spawned.agg(F.sum(n).alias("total"), F.avg(n).alias("mean"), F.max(n).alias("most"), F.count_if(F.col(n) > many).alias("many"))


def activity(df: DataFrame, key: str, ts: str, label: str) -> DataFrame:
    """(key, first, last, labels, n): first and last time in epoch ms, the labels in order."""
    return df.groupBy(key).agg(F.unix_millis(F.min(ts)).alias("first"), F.unix_millis(F.max(ts)).alias("last"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.count("*").alias("n"))


def durations(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, first, last, n, seconds) by start: how long each tactic lasted."""
    rows = df.groupBy(key).agg(F.unix_millis(F.min(ts)).alias("first"), F.unix_millis(F.max(ts)).alias("last"), F.count("*").alias("n"))
    return rows.withColumn("seconds", (F.col("last") - F.col("first")) / 1000.0).orderBy("first", key)


