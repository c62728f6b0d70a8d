"""Traffic analytics: talkers, scans, frequent pairs, outliers, direction, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemaris.functions.classify import CLEAR_PORTS, ENCRYPTED_PORTS, ip_class, is_external_ip


def top_by(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, total, n): the k keys with the largest sums."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), key).limit(k)


def host_activity(df: DataFrame, host: str, amount: str, packets: str, first: dict[str, tuple[str, Column]]) -> DataFrame:
    """Sums per host, and for each of `first` (name -> column, order) the first value."""
    return df.groupBy(host).agg(
        F.sum(amount).alias("total_bytes"), F.avg(amount).alias("mean_bytes"), F.sum(packets).alias("total_packets"), F.count("*").alias("n"),
        *(F.min_by(c, order).alias(name) for name, (c, order) in first.items()),
    )


def process_use(df: DataFrame, process: str, amount: str, port: str) -> DataFrame:
    """(process, total_bytes, mean_bytes, flows, ports): what each process sends; flows without a process are left out."""
    return df.where(F.col(process).isNotNull()).groupBy(process).agg(F.sum(amount).alias("total_bytes"), F.avg(amount).alias("mean_bytes"), F.count("*").alias("flows"), F.count_distinct(port).alias("ports"))


def external_destinations(df: DataFrame, destination: str, amount: str, k: int = 10) -> DataFrame:
    """(destination, total, n): the external addresses that most bytes went to."""
    return top_by(df.where(is_external_ip(destination)), destination, amount, k)


def directions(df: DataFrame, source: str, destination: str) -> DataFrame:
    return df.groupBy(ip_class(source).alias("source_class"), ip_class(destination).alias("destination_class")).agg(F.count("*").alias("n"))


def bytes_per_packet(df: DataFrame, amount: str, packets: str, large: float) -> DataFrame:
    """One row: mean bytes per packet where there are packets, and the share of flows above `large` bytes."""
    return df.agg(F.avg(F.when(F.col(packets) > 0, F.col(amount) / F.col(packets))).alias("bytes_per_packet"), F.avg(F.when(F.col(amount) > large, 1.0).otherwise(0.0)).alias("large_share"))


def scan_suspects(df: DataFrame, source: str, port: str, most_ports: int) -> DataFrame:
    """Sources with more than most_ports different ports. Distinct pairs are aggregated before the second shuffle."""
    return df.groupBy(source).agg(F.count_distinct(port).alias("ports"), F.count("*").alias("flows")).where(F.col("ports") > most_ports)


def frequent_pairs(df: DataFrame, source: str, destination: str, amount: str, most: int) -> DataFrame:
    return df.groupBy(source, destination).agg(F.count("*").alias("flows"), F.avg(amount).alias("mean_bytes")).where(F.col("flows") > most)


def multi_record(df: DataFrame, flow: str) -> DataFrame:
    """One row: flow ids, mean and most records per id, and the share of ids with more than one."""
    per = df.groupBy(flow).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("flows"), F.avg("n").alias("mean_records"), F.max("n").alias("most_records"), F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("multi_share"))


def port_security(df: DataFrame, port: str) -> DataFrame:
    kind = F.when(F.col(port).isin(*ENCRYPTED_PORTS), "encrypted").when(F.col(port).isin(*CLEAR_PORTS), "clear").otherwise("other")
    return df.where(F.col(port).isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def listed_ports(df: DataFrame, port: str, ports: tuple[int, ...]) -> DataFrame:
    return df.where(F.col(port).isin(*ports)).groupBy(port).agg(F.count("*").alias("n"))


def reuse(df: DataFrame, key: str, reused: str) -> DataFrame:
    """One row: distinct (key, reused) pairs for each distinct reused value; flagged above 1.1."""
    row = df.agg(F.count_distinct(key, reused).alias("pairs"), F.count_distinct(reused).alias("values"))
    ratio = F.try_divide(F.col("pairs"), F.col("values"))
    return row.select("pairs", "values", ratio.alias("ratio"), (ratio > 1.1).alias("reused"))


def fanout(children: DataFrame, parent: str) -> DataFrame:
    """(parent, children), for parents that have any."""
    return children.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count("*").alias("children"))


def orphans(children: DataFrame, parent: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not in the table."""
    return children.where(F.col(parent).isNotNull()).join(parents.select(F.col(key).alias(parent)), parent, "left_anti")


def fanout_summary(fan: DataFrame, many: int = 10) -> DataFrame:
    """One row over fanout(): parents, mean and most children, and how many parents have more than `many`."""
    return fan.agg(F.count("*").alias("parents"), F.avg("children").alias("mean"), F.max("children").alias("most"), F.count_if(F.col("children") > many).alias("prolific"))


def traffic_summary(df: DataFrame, source: str, destination: str, amount: str) -> DataFrame:
    """One row: flows, bytes, distinct ends, and the most frequent destination (the smallest on ties).

    All come from counts by pair and then by end, so no task holds all destinations.
    """
    pairs = df.groupBy(source, destination).agg(F.count("*").alias("n"), F.sum(amount).alias("bytes"))
    to = pairs.groupBy(destination).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    row = to.agg(F.sum("n").alias("flows"), F.sum("bytes").alias("bytes"), F.count(destination).alias("destinations"), F.min_by(destination, F.struct((-F.col("n")).alias("m"), destination)).alias("top_destination"))
    sources = pairs.groupBy(source).agg(F.lit(1).alias("one")).agg(F.count(source).alias("sources"))
    return row.join(F.broadcast(sources)).select("flows", "bytes", "sources", "destinations", "top_destination")
