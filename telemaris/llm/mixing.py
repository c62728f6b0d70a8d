"""Mixing sources to target weights by entropy balancing.

Of all rates r for the documents that give each source its target of tokens, sum(size * r) = target, the
one nearest to taking each document once (least sum of r * log(r) - r, with 0 <= r <= most) is
r = min(most, exp(lambda_source * size / mean size)): exponentially tilted, with one multiplier per
source. The dual is convex in the multipliers; Newton's iterations solve it for all sources at once, each
an aggregation over (source, size, count), which the documents are summed up in first. A step that
leaves the bracket of the root is replaced by a bisection. Then the rates are rounded into copies size by size, the largest first, each carrying its
error on to the next; documents of one source and size have one rate, and those first by a hash take the copy more.

Sums are decimal, so that neither partitions nor retries change a bit of them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemaris.llm import common as c

WORD = r"[^\x20\x09-\x0D]+"
OF, SIZE, ONE, TWO, N = (f"{c.OWN}{x}" for x in ("of", "size", "one", "two", "n"))
EXACT = "decimal(38,6)"


def word_count(text: str) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes (source, source_size, n_docs) with `target`: all tokens, shared by weight, no source above `most` times its size.

    Sources take the weights in turn, by code point, null last. The level up to which weights are filled is
    found over the sources in the order in which they reach their caps. One row per source, so a window over
    all of them is small.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("turn", F.col("cap") / F.col("weight"))
    full = W.orderBy("turn", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / open_weight)
    first = F.when(F.col("level") <= F.col("turn"), F.struct(F.row_number().over(full).alias("k"), "level"))
    rows = rows.withColumn("first", first)
    level = F.min("first").over(everything)["level"]
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("turn", "level", "first")


def multipliers(counts: DataFrame, goals: DataFrame, most: int, tolerance: float, most_rounds: int) -> DataFrame:
    """goals (source, source_size, n_docs, target) with `lam` and `mean`, by Newton's iterations on the dual."""
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    start = F.when(F.col("target") > 0, F.log(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0.0)
    state = goals.select("*", mean.alias("mean"), start.alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    state = c.written(state, "multipliers")
    for _ in range(most_rounds):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        tokens = F.col("n") * F.col("size")
        sums = counts.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).groupBy("source").agg(
            F.sum((tokens * F.least(tilt, F.lit(float(most)))).cast(EXACT)).cast("double").alias("taken"),
            F.sum(F.when(tilt < most, tokens * x * tilt).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
        )
        now = state.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        gap = F.col("taken") - F.col("target")
        now = now.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        inside = F.when((newton > F.col("low")) & (newton < F.col("high")), newton)
        doubled = F.when(F.col("high") == 1e6, F.greatest(F.col("lam") * 2, F.lit(1.0))).when(F.col("low") == -1e6, F.least(F.col("lam") * 2, F.lit(-1.0)))
        done = (F.abs(gap) <= tolerance * F.col("target")) | (F.col("target") >= F.col("source_size") * most) | (F.col("target") <= 0)
        now = now.withColumn("off", F.when(done, F.lit(0.0)).otherwise(F.abs(gap)))
        now = now.withColumn("lam", F.when(done, F.col("lam")).otherwise(F.coalesce(inside, doubled, (F.col("low") + F.col("high")) / 2)))
        now = c.written(now.select(*state.columns, "off"), "multipliers")
        state = now.drop("off")
        if not now.agg(F.max("off")).first()[0]:
            break
    else:
        raise RuntimeError(f"the multipliers did not come within {tolerance} of their targets in {most_rounds} rounds")
    return state.select(*goals.columns, "mean", "lam")


def rounded(rows: pa.Table, most: int) -> pa.Table:
    """For each size of one source (its number n of documents and their rate): copies of each, and how many take one more.

    The tokens taken follow the sum of the rates, from the largest size down, to within half a document.
    """
    rows = rows.sort_by([(SIZE, "descending")])
    low, more, carry = [], [], 0.0
    for size, n, rate in zip(*(rows[x].to_pylist() for x in (SIZE, N, "rate")), strict=True):
        floor = math.floor(rate)
        if not size or floor == rate:
            low.append(min(most, round(rate)))
            more.append(0)
            continue
        want = rate * n * size + carry
        total = min(max(round(want / size), floor * n), min(most, floor + 1) * n)
        low.append(floor)
        more.append(total - floor * n)
        carry = want - total * size
    return rows.append_column("low", pa.array(low, pa.int64())).append_column("more", pa.array(more, pa.int64()))


def allotted(entries: DataFrame) -> DataFrame:
    """entries (OF, SIZE, ONE, TWO, N, more) with `ups`: how many of an entry's N equal rows take a copy more.

    Of one source and size those first by hash. Places are counted within ranges of the hash, after the rows of the ranges before.
    """
    ranged = entries.withColumn("range", F.shiftright(ONE, 54))
    sums = ranged.groupBy(OF, SIZE, "range").agg(F.sum(N).alias("held"))
    base = F.sum("held").over(W.partitionBy(OF, SIZE).orderBy("range")) - F.col("held")
    sums = sums.select(F.col(OF).alias("of"), F.col(SIZE).alias("size"), F.col("range").alias("r"), base.alias("base"))
    both = ranged.join(sums, F.col(OF).eqNullSafe(F.col("of")) & (F.col(SIZE) == F.col("size")) & (F.col("range") == F.col("r")))
    before = F.col("base") + F.sum(N).over(W.partitionBy(OF, SIZE, "range").orderBy(ONE, TWO)) - F.col(N)
    return both.withColumn("ups", F.least(F.greatest(F.col("more") - before, F.lit(0)), F.col(N))).select(*entries.columns, "ups")


def mixed(docs: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """docs with `source_size`, `target`, `rate`, `copies` and `taken` (copies * size).

    source: its name; null is a source of its own, after all others. size: each document's tokens (long);
    null counts as 0. A document of size 0 changes no sum: its rate is 1 (at the cap: most). Rows that
    repeat, in all columns, are documents of their own: they are counted as one entry, so any number of them is one row,
    and as many of them as the rounding says take a copy more. Input columns with the names of the results are replaced; other
    columns stay. An empty table gives an empty table. Raises RuntimeError if the targets are not reached in most_rounds.
    """
    c.check_columns(docs, source, size)
    docs = docs.drop("source_size", "target", "rate", "copies", "taken").withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    columns = docs.columns
    nulls = [F.col(x).isNull() for x in columns]  # xxhash64 skips nulls
    keyed = docs.select("*", F.col(source).cast("string").alias(OF), F.col(size).alias(SIZE), F.xxhash64(F.lit(1), *nulls, *columns).alias(ONE), F.xxhash64(F.lit(2), *nulls, *columns).alias(TWO))
    entries = c.written(keyed.groupBy(OF, SIZE, ONE, TWO).agg(F.count("*").alias(N)), "entries")
    counts = c.written(entries.groupBy(F.col(OF).alias("source"), F.col(SIZE).alias("size")).agg(F.sum(N).alias("n")), "sizes")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    solved = multipliers(counts, targets(sizes, weights, most), most, tolerance, most_rounds)
    tilt = F.exp(F.least(F.col("lam") * F.col(SIZE) / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("target") >= F.col("source_size") * most, float(most)).otherwise(F.least(F.lit(float(most)), tilt))
    rates = counts.select(F.col("source").alias(OF), F.col("size").alias(SIZE), F.col("n").alias(N)).join(solved, F.col(OF).eqNullSafe(F.col("source")))
    rates = rates.select(OF, SIZE, N, "source_size", "target", rate.alias("rate"))
    plan = c.written(rates.groupBy(OF).applyInArrow(lambda t: rounded(t, most), c.schema_with(rates, "low long, more long")), "rates")  # a row for each size of a source
    own = {x: f"{c.OWN}its_{x}" for x in ("of", "size", "one", "two", "low", "ups", "n", "block", "place")}  # names that no column of docs has
    sized = plan.drop(N).withColumnsRenamed({OF: own["of"], SIZE: own["size"]})
    entries = entries.join(sized, F.col(OF).eqNullSafe(F.col(own["of"])) & (F.col(SIZE) == F.col(own["size"]))).drop(own["of"], own["size"])
    entries = c.written(allotted(entries), "copies")
    whole = (F.col("ups") == 0) | (F.col("ups") == F.col(N))
    names = [F.col(x).alias(own[y]) for x, y in ((OF, "of"), (SIZE, "size"), (ONE, "one"), (TWO, "two"))]
    chosen = entries.where(whole).select(*names, "source_size", "target", "rate", (F.col("low") + F.when(F.col("ups") > 0, 1).otherwise(0)).alias("copies"))
    same = F.col(OF).eqNullSafe(F.col(own["of"])) & (F.col(SIZE) == F.col(own["size"])) & (F.col(ONE) == F.col(own["one"])) & (F.col(TWO) == F.col(own["two"]))
    taken = (F.col("copies") * F.col(size)).alias("taken")
    results = ["source_size", "target", "rate", "copies"]
    out = keyed.join(chosen, same).select(*columns, *results, taken)
    # Equal rows of which some take a copy more: one row with its number, dealt out in blocks.
    n, low, ups, block, place = (F.col(own[x]) for x in ("n", "low", "ups", "block", "place"))
    parted = entries.where(~whole).select(*names, "source_size", "target", "rate", F.col("low").alias(own["low"]), F.col("ups").alias(own["ups"]))
    if parted.isEmpty():
        return out
    equal = keyed.join(parted, same).groupBy(*columns, "source_size", "target", "rate", own["low"], own["ups"]).agg(F.count("*").alias(own["n"]))
    length = 10_000
    blocks = equal.withColumn(own["block"], F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / length))))
    first = block * length + 1
    rows = blocks.withColumn(own["place"], F.explode(F.sequence(first, F.least(first + length - 1, n))))
    rows = rows.withColumn("copies", low + F.when(place <= ups, 1).otherwise(0))
    return out.unionByName(rows.select(*columns, *results, taken))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's share in the mix of all sources at weights 5, 2, 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = c.written(docs.select("doc_id", "source", word_count("text").alias("size")), "sized")
    return mixed(slim).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
