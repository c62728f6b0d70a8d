"""Splits without leakage, and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemaris.operators.ordered import evenly_spaced, hash_order, overlapped, positions
from telemaris.session import written


def cut(place: Column, n: Column, shares: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the first share whose end lies at or after the place (from 1) among n."""
    out, total = None, 0.0
    for share, name in zip(shares[:-1], names[:-1], strict=True):
        total += share
        hit = place <= F.floor(n * F.lit(round(total, 9)) + 1e-9)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(names[-1])


def numbered(df: DataFrame, strata: list[str], key: str, seed: int, place: str, total: str) -> DataFrame:
    """df with each row's place, from 1, within its stratum by a hash of the key, and the stratum's size.

    Places come from running counts over hash ranges, so a stratum that holds most rows is many tasks' work.
    """
    ordered = df.withColumn("__h", hash_order(key, seed))
    buckets = 1024  # of the 32-bit hash: a stratum's bucket is numbered within itself, after the buckets before it
    ordered = ordered.withColumn("__b", F.floor(F.col("__h") / (2**32 / buckets)))
    sizes = ordered.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*strata).orderBy("__b")
    names = {s: f"__s{i}" for i, s in enumerate(strata)}
    sizes = sizes.select(*(F.col(s).alias(n) for s, n in names.items()), F.col("__b").alias("__sb"), (F.sum("__n").over(w) - F.col("__n")).alias("__base"), F.sum("__n").over(W.partitionBy(*strata)).alias(total))
    same = F.col("__b") == F.col("__sb")
    for s, n in names.items():
        same = same & F.col(s).eqNullSafe(F.col(n))
    here = F.row_number().over(W.partitionBy(*strata, "__b").orderBy("__h", key)) + F.col("__base")
    return ordered.join(sizes, same).withColumn(place, here).select(*df.columns, place, total)


def stratified(df: DataFrame, key: str, stratum: str, shares: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """df with `split`: each stratum in the order of a hash of the key, cut at the shares."""
    placed = numbered(df, [stratum], key, seed, "__place", "__total")
    return placed.withColumn("split", cut(F.col("__place"), F.col("__total"), shares, names)).select(*df.columns, "split")


def benign_ratio(df: DataFrame, label: str, benign: str) -> DataFrame:
    """(split, n, benign_ratio) of a table with `split`."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col(label) == benign).cast("double")).alias("benign_ratio"))


def by_session(df: DataFrame, campaign: str, session: str, order: list[str], test: tuple[str, ...], val_sessions: int = 2, val_share: float = 0.3) -> DataFrame:
    """df with `split`: test campaigns; of each other campaign the first sessions by name are val, the rest train.

    A campaign with no more than val_sessions sessions gives its first rows, val_share of them, to val.
    """
    sessions = df.select(campaign, session).distinct()
    w = W.partitionBy(campaign)
    sessions = sessions.select(F.col(campaign).alias("__c"), F.col(session).alias("__s"), F.row_number().over(w.orderBy(session)).alias("__rank"), F.count("*").over(w).alias("__sessions"))
    both = df.join(sessions, (F.col(campaign) == F.col("__c")) & F.col(session).eqNullSafe(F.col("__s")))
    few = (F.col("__sessions") <= val_sessions) & ~F.col(campaign).isin(*test)
    split = F.when(F.col(campaign).isin(*test), "test").when(F.col("__rank") <= val_sessions, "val").otherwise("train")
    many_rows = both.where(~few).withColumn("split", split)
    placed = positions(both.where(few).select(*df.columns), [F.col(campaign), *order], "__place")  # one such campaign may hold most rows
    ends = placed.groupBy(campaign).agg(F.min("__place").alias("__first"), F.count("*").alias("__n")).withColumnRenamed(campaign, "__c")
    placed = placed.join(ends, F.col(campaign).eqNullSafe(F.col("__c")))
    few_rows = placed.withColumn("split", F.when(F.col("__place") - F.col("__first") < F.floor(F.col("__n") * val_share + 1e-9), "val").otherwise("train"))
    return many_rows.select(*df.columns, "split").unionByName(few_rows.select(*df.columns, "split"))


def by_tiles(df: DataFrame, order: list[str], key: str, label: str, tiles: int = 10, train: float = 0.7, least: int = 10, seed: int = 42) -> DataFrame:
    """df with `split`: time is cut into tiles of rows // tiles rows (and a rest); in each, `train` of every label by hash.

    Tiles below `least` rows drop out. A tile where that cannot work (a label with one row, or fewer rows on a side than labels)
    falls back to position: its first rows are train. What is left over is halved into val and test within its label, by hash.
    """
    placed = written(positions(df, order), "places")
    width = F.greatest(F.floor(F.lit(placed.count()) / tiles), F.lit(1))
    tiled = placed.withColumn("tile", F.floor((F.col("position") - 1) / width))
    labels = tiled.groupBy("tile", label).agg(F.count("*").alias("__n"), F.min("position").alias("__first"))
    full = labels.groupBy("tile").agg(F.sum("__n").alias("__rows"), F.min("__n").alias("__least"), F.count("*").alias("__labels"), F.min("__first").alias("__first")).where(F.col("__rows") >= least)
    ahead = F.floor(F.col("__rows") * train + 1e-9)
    full = full.select("tile", ((F.col("__least") < 2) | (ahead < F.col("__labels")) | (F.col("__rows") - ahead < F.col("__labels"))).alias("__by_position"), (F.col("__first") + ahead - 1).alias("__last"))
    columns = [*df.columns, "tile"]
    inner = [*columns, "position", "__by_position", "__last"]
    sized = numbered(tiled.join(F.broadcast(full), "tile").select(*inner), ["tile", label], key, seed, "__place", "__total")  # tiles + 1 rows, or one for each row of a small table
    by_hash = F.col("__place") <= F.floor(F.col("__total") * train + 1e-9)
    sized = sized.withColumn("__train", F.when(F.col("__by_position"), F.col("position") <= F.col("__last")).otherwise(by_hash)).select(*columns, "__train")
    sized = written(sized, "tiles")  # numbered() reads its input twice
    rest = numbered(sized, ["tile", label, "__train"], key, seed + 1, "__place", "__total")
    return rest.withColumn("split", F.when(F.col("__train"), "train").when(F.col("__place") % 2 == 1, "val").otherwise("test")).select(*columns, "split")


def sequences(df: DataFrame, session: str, order: list[str], features: str, label: str, key: str, length: int, most: int | None = None) -> DataFrame:
    """(session, key, features, label): each run of `length` successive rows of a session, named and labelled by its last.

    With `most`, evenly spaced ones are picked in each session before any features are collected. Rows are placed by range of
    (session, order), so one session may hold most rows.
    """
    if most is None:
        rows = overlapped(df, [session], order, length - 1)
        back = W.partitionBy(session, "__block").orderBy("__place").rowsBetween(-(length - 1), 0)
        out = rows.withColumn("__f", F.collect_list(features).over(back)).withColumn("__n", F.count("*").over(back)).where(F.col("__own") & (F.col("__n") == length))
        return out.select(session, key, F.col("__f").alias("features"), label)
    rows = written(positions(df, [session, *order], "__at"), "places")
    ends = rows.groupBy(session).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows")).withColumnRenamed(session, "__s")
    ends = ends.where(F.col("__rows") >= length).withColumn("__picked", evenly_spaced(F.col("__rows") - length + 1, most))
    wanted = rows.join(ends, F.col(session).eqNullSafe(F.col("__s"))).where(F.array_contains("__picked", F.col("__at") - F.col("__first") + 1 - length))
    wanted = wanted.select(session, F.col(key).alias("__key"), F.col(label).alias("__label"), F.explode(F.sequence(F.col("__at") - length + 1, F.col("__at"))).alias("__at"))
    steps = wanted.join(rows.select("__at", F.col(features).alias("__f")), "__at")
    found = steps.groupBy(session, F.col("__key").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__f"))), lambda x: x["__f"]).alias("features"), F.first("__label").alias(label))
    return found.select(session, key, "features", label)
