"""Global order without a single task: running sums, positions and samples over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from telemaris.session import written

RANGE = "__range"


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str | Column]) -> DataFrame:
    """df with inclusive running sums in the given total order.

    Rows are dealt by range of the order, so each task sums its own range; what the ranges before it hold is one
    row per range, summed up over those few rows. Rows that tie in the order should be one row before.
    """
    values = {f"__{k}": (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    ranged = df.withColumns(values).repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).withColumn(RANGE, F.spark_partition_id())
    ranged = written(ranged, "ranges")  # the partition numbers must not change between the two passes
    before = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(RANGE).agg(*(F.sum(f"__{k}").alias(f"__t_{k}") for k in sums))
    bases = totals.select(RANGE, *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums))
    here = W.partitionBy(RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(bases, RANGE)
    return out.select(*df.columns, *((F.sum(f"__{k}").over(here) + F.col(f"__b_{k}")).alias(k) for k in sums))


def positions(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """df with each row's place, from 1, in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")})


def overlapped(df: DataFrame, keys: list[str], order: list[str], before: int, block: int = 100_000) -> DataFrame:
    """df with `__place` in the order of keys, then `order`, and `__block`: runs of `block` rows, each with the `before` rows ahead of it too.

    Rows that are a block's own, not repeated from an earlier one, have `__own`. A window by keys and block that looks back over
    `before` rows sees what one by keys alone would, and no task holds all rows of a key.
    """
    placed = positions(df, [*keys, *order], "__place")
    at = lambda ahead: F.floor((F.col("__place") - 1 + ahead) / block)
    return placed.withColumn("__block", F.explode(F.sequence(at(0), at(before)))).withColumn("__own", F.col("__block") == at(0))


#: Sketches for brackets tell ranks apart to one part in so many; twice that to either side of a quantile is its bracket.
RANKS = 10_000
#: So many values of a bracket may go to the driver; a fuller bracket is narrowed first.
MOST_VALUES = 100_000
#: So many keys have their quantiles selected side by side.
MOST_KEYS = 32


def selected(df: DataFrame, columns: dict[str, str | Column], at: list[float]) -> dict[str, list[float | None]]:
    """The exact quantiles `at` of each column, with linear interpolation; None without values, NaN above all numbers.

    No sort and no table of values: mergeable sketches bracket each quantile, a pass counts what lies below and inside the
    brackets, and the few different values inside decide. Counts prove each bracket: one that misses its quantile is opened, one
    that holds too much is narrowed by a sketch of its inside. Every pass is one aggregation without a shuffle of rows.
    """
    values = [F.when(~F.isnan(x), x) for x in ((F.col(c) if isinstance(c, str) else c).cast("double") for c in columns.values())]
    rows = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values)), *((F.col(c) if isinstance(c, str) else c).isNotNull().alias(f"n{i}") for i, c in enumerate(columns.values())))
    k, e = len(columns), 2 / RANKS
    probes = [p for q in at for p in (max(q - e, 0.0), min(q + e, 1.0))]
    first = rows.agg(*(F.count_if(f"n{i}").alias(f"n{i}") for i in range(k)), *(F.count(f"v{i}").alias(f"m{i}") for i in range(k)), *(F.percentile_approx(f"v{i}", probes, RANKS).alias(f"p{i}") for i in range(k))).first()
    goals = {(i, j): q * (first[f"n{i}"] - 1) for i in range(k) for j, q in enumerate(at) if first[f"n{i}"]}
    found: dict[tuple[int, int], tuple[float, float]] = {}  # the values at the ranks below and above a goal
    todo = {}
    for (i, j), goal in goals.items():
        if math.floor(goal) >= first[f"m{i}"]:
            found[i, j] = (math.nan, math.nan)
        else:
            todo[i, j] = (first[f"p{i}"][2 * j], first[f"p{i}"][2 * j + 1])
    while todo:
        keys = list(todo)
        counts = rows.agg(*(F.count_if(F.col(f"v{i}") < F.lit(todo[i, j][0])).alias(f"b{x}") for x, (i, j) in enumerate(keys)), *(F.count_if(F.col(f"v{i}").between(F.lit(todo[i, j][0]), F.lit(todo[i, j][1]))).alias(f"w{x}") for x, (i, j) in enumerate(keys))).first()
        narrow, small = {}, {}
        for x, (i, j) in enumerate(keys):
            (lo, hi), below, inside = todo[i, j], counts[f"b{x}"], counts[f"w{x}"]
            low, high = math.floor(goals[i, j]), min(math.ceil(goals[i, j]), first[f"m{i}"] - 1)
            if below > low or below + inside <= high:
                narrow[i, j] = (-math.inf if below > low else lo, math.inf if below + inside <= high else hi, 0, 0)
            elif lo == hi:
                found[i, j] = (lo, hi)
            elif inside > MOST_VALUES:
                narrow[i, j] = (lo, hi, (low - below) / inside, (high - below + 1) / inside)
            else:
                small[i, j] = (lo, hi, below)
        if small:
            pairs = F.array(*(F.when(F.col(f"v{i}").between(F.lit(lo), F.lit(hi)), F.struct(F.lit(x).alias("x"), F.col(f"v{i}").alias("v"))) for x, ((i, j), (lo, hi, _)) in enumerate(small.items())))
            inside = rows.select(F.explode(F.array_compact(pairs)).alias("p")).groupBy("p.x", "p.v").agg(F.count("*").alias("n")).collect()  # MOST_VALUES for each quantile
            for x, ((i, j), (_, _, below)) in enumerate(small.items()):
                found[i, j] = tuple(_at_rank(sorted((r["v"], r["n"]) for r in inside if r["x"] == x), rank - below) for rank in (math.floor(goals[i, j]), min(math.ceil(goals[i, j]), first[f"m{i}"] - 1)))
        todo = {}
        sketched = {key: v for key, v in narrow.items() if v[3]}
        if sketched:
            again = rows.agg(*(F.percentile_approx(F.when(F.col(f"v{i}").between(F.lit(lo), F.lit(hi)), F.col(f"v{i}")), [max(a - e, 0.0), min(b + e, 1.0)], RANKS).alias(f"p{x}") for x, ((i, _), (lo, hi, a, b)) in enumerate(sketched.items()))).first()
            todo = {key: tuple(again[f"p{x}"]) for x, key in enumerate(sketched)}
            for key in [key for key in todo if todo[key] == sketched[key][:2]]:  # few values, many times each
                lo, hi = todo.pop(key)
                i = key[0]
                tied = rows.where(F.col(f"v{i}").between(F.lit(lo), F.lit(hi))).groupBy(f"v{i}").agg(F.count("*").alias("n")).collect()
                below = counts[f"b{keys.index(key)}"]
                found[key] = tuple(_at_rank(sorted((r[0], r["n"]) for r in tied), rank - below) for rank in (math.floor(goals[key]), min(math.ceil(goals[key]), first[f"m{i}"] - 1)))
        todo |= {key: v[:2] for key, v in narrow.items() if not v[3]}
    out = {}
    for i, name in enumerate(columns):
        ends = [(found[i, j], goals[i, j]) if (i, j) in goals else None for j in range(len(at))]
        out[name] = [None if x is None else math.nan if math.ceil(x[1]) >= first[f"m{i}"] else _between(*x[0], x[1] - math.floor(x[1])) for x in ends]
    return out


def _between(a: float, b: float, part: float) -> float:
    return a if a == b or not part else a + (b - a) * part


def _at_rank(counts: list[tuple[float, int]], rank: int) -> float:
    """The value at a rank from 0 among ascending values with counts."""
    for value, n in counts:
        if rank < n:
            return value
        rank -= n
    raise ValueError("a rank beyond its bracket")


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row (limit): the quantile with linear interpolation, null without values."""
    (limit,) = selected(df, {"x": column}, [q])["x"]
    return df.sparkSession.range(1).select(F.lit(limit).cast("double").alias("limit"))


def exact_quantiles(df: DataFrame, columns: dict[str, str | Column], at: list[float]) -> DataFrame:
    """(name, q0, q1, ...): the quantiles `at` of each of the columns (name -> numeric column), with linear interpolation."""
    found = selected(df, columns, at)
    kind = T.StructType([T.StructField("name", T.StringType()), *(T.StructField(f"q{i}", T.DoubleType()) for i in range(len(at)))])
    return df.sparkSession.createDataFrame([(n, *v) for n, v in found.items() if v[0] is not None], kind)


def quantiles_by(df: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """(key, q0, q1, ...): exact quantiles of a column for each key, however many rows one has; keys without values are left out.

    Up to MOST_KEYS keys are selected side by side; for more, counts of values are summed by range.
    """
    some = df.where(F.col(value).isNotNull())
    keys = [r[0] for r in some.select(key).distinct().limit(MOST_KEYS + 1).collect()]
    if len(keys) <= MOST_KEYS:
        found = selected(some, {i: F.when(F.col(key).eqNullSafe(F.lit(x)), F.col(value)) for i, x in enumerate(keys)}, at) if keys else {}
        kind = T.StructType([df.schema[key], *(T.StructField(f"q{i}", T.DoubleType()) for i in range(len(at)))])
        return df.sparkSession.createDataFrame([(keys[i], *v) for i, v in found.items()], kind)
    counts = some.groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = running(counts, [F.col(key).asc_nulls_first(), "v"], {"upto": "n"})
    total = placed.groupBy(key).agg(F.sum("n").alias("total"), F.max("upto").alias("last")).select(F.col(key).alias("__k"), "total", (F.col("last") - F.col("total")).alias("base"))
    both = placed.join(total, F.col(key).eqNullSafe(F.col("__k"))).withColumn("place", F.col("upto") - F.col("base"))
    ends = []
    for i, q in enumerate(at):
        goal = F.lit(q) * (F.col("total") - 1)
        ends += [F.min(F.when(F.col("place") >= F.floor(goal) + 1, F.col("v"))).alias(f"a{i}"), F.min(F.when(F.col("place") >= F.ceil(goal) + 1, F.col("v"))).alias(f"b{i}"), F.max(goal - F.floor(goal)).alias(f"p{i}")]
    rows = both.groupBy(key).agg(*ends)
    return rows.select(key, *((F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"p{i}")).alias(f"q{i}") for i in range(len(at))))


def hash_order(key: str, seed: int) -> Column:
    """A number from the key and a seed that any engine can work out: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same in each run: those first by hash."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def every_kth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """About every (rows // n)-th row of a total order, n rows at most."""
    step = max(1, df.count() // n)
    return positions(df, order).where((F.col("position") - 1) % step == 0).where(F.col("position") <= step * n).drop("position")


def first_by(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first in the order. The aggregate keeps one row per key and task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*key, *(F.col("__row")[c].alias(c) for c in rest)).select(df.columns)


def evenly_spaced(total: Column, n: int) -> Column:
    """Array of n places round(i * total / n), half to even; all places if there are no more than n."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * total / n).cast("long"))
    return F.when(total <= n, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1)).otherwise(spaced)
