"""Phrase collocations by counting quotient filters.

1. Texts are read once: slices of some megabytes become word numbers of their own and a list of their words with counts.
2. Spark sums the words, numbers those that are frequent enough to stand in a phrase, and each slice gets their numbers back.
3. For two words, then three: each slice counts its n-grams in a quotient filter, cut into shards by the first bits of the
   permuted keys. A task merges a shard's sorted filters, and answers each slice with one bit per n-gram: whether it is frequent
   in all. Longer n-grams are counted only where both shorter ones are, as a phrase is never more frequent than its parts.
4. Frequent phrases, few against the text, are joined with their parts' counts and ranked in SQL.

A word in every text costs one entry per slice, and permuted keys spread evenly over shards: no key is hot. Slices follow the
input's order, so any number of copies spread. Counts are exact at every size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from telemaris.llm import common as c
from telemaris.llm import quotient_filter as qf
from telemaris.operators.ordered import positions

BREAK = b"\xff"  # in no UTF-8 text
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A-Z become a-z, separators BREAK.
NORMAL = bytes(255 if x in SEPARATORS else x + 32 if 65 <= x <= 90 else x for x in range(256))
UNKNOWN = "und"
MERGED = -1


class Slice:
    """Word numbers of some texts: from 1 as they come, per language; 0 stands between pieces and after each text."""

    def __init__(self):
        self.next = count(1)
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = defaultdict(self.next.__next__, {BREAK: 0})
        words = text.translate(NORMAL).replace(BREAK, b" \xff ").split()
        words.append(BREAK)
        self.tokens.append(np.fromiter(map(self.numbers[lang].__getitem__, words), np.uint32, len(words)))
        self.size += len(text)

    def row(self, number: int) -> dict[str, pa.Array]:
        tokens = np.concatenate(self.tokens)
        n = np.bincount(tokens)
        own = [(lang, [(k, w) for w, k in words.items() if k]) for lang, words in self.numbers.items()]
        order = np.argsort([k for _, words in own for k, _ in words])  # numbers of two languages take turns
        langs = pa.array([lang for lang, words in own for _ in words], pa.string()).take(order)
        words = pa.array([w for _, words in own for _, w in words], pa.binary()).take(order).cast(pa.string())
        listed = pa.StructArray.from_arrays([langs, words, pa.array(n[1:], pa.int64())], ["lang", "word", "n"])
        blob = tokens.astype("<u2").tobytes() if len(n) <= 1 << 16 else tokens.astype("<u4").tobytes()
        return {"slice": pa.array([number], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "tokens": pa.array([blob], pa.binary()), "words": pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)}


SLICES = "slice long, n_tokens long, tokens binary, words array<struct<lang: string, word: string, n: long>>"


def sliced(docs: DataFrame, lang: str, text: str, slice_bytes: int) -> DataFrame:
    """One row for about slice_bytes of text; written, as its number is that of the task that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth, part = TaskContext.get().partitionId() << 32, 0, Slice()
        for batch in batches:
            for one, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                part.add(one, raw.as_py())
                if part.size >= slice_bytes:
                    yield pa.RecordBatch.from_pydict(part.row(base + nth))
                    nth, part = nth + 1, Slice()
                    c.give_back()
        if part.tokens:
            yield pa.RecordBatch.from_pydict(part.row(base + nth))
        batch = part = raw = None
        c.give_back()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    return c.written(rows.mapInArrow(run, SLICES), "slices")


def numbered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice's tokens under the numbers that all slices share; 0 where a word is too rare."""
    layout = pa.schema([("slice", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])
    if not left.num_rows:
        return layout.empty_table()
    blob, n = left["tokens"][0].as_py(), left["n_tokens"][0].as_py()
    tokens = np.frombuffer(blob, f"<u{len(blob) // n}")
    shared = np.zeros(int(tokens.max()) + 1, np.int64)
    shared[right["local"].to_numpy()] = right["id"].to_numpy()
    shared = shared.astype("<u4" if shared.max() < 1 << 32 else "<u8")  # the tokens have all of them
    return pa.table({"slice": left["number"], "n_tokens": left["n_tokens"], "tokens": [shared[tokens].tobytes()]}, schema=layout)


class Counting:
    """One slice's n-grams, level by level: those whose words, and whose shorter n-grams, are frequent in all slices."""

    def __init__(self, tokens: np.ndarray, n_ids: int):
        self.tokens, self.n_ids = tokens, n_ids
        self.alive = tokens > 0

    def keys(self, words: int, some: int = 1 << 17) -> tuple[qf.Packing, np.ndarray]:
        """The permuted keys of the n-grams that are left at this level; `some` at a time are unpacked words."""
        both = self.alive.copy()
        both[-1:] = False
        both[:-1] &= self.alive[1:]
        self.at = np.flatnonzero(both)
        packing, keys = qf.Packing(self.n_ids, words), np.empty(len(self.at), qf.KEY)
        for a in range(0, len(keys), some):
            keys[a : a + some] = packing.permuted(self.tokens[self.at[a : a + some, None] + np.arange(words)])
        return packing, keys

    def keep(self, packing: qf.Packing, keys: np.ndarray, frequent: np.ndarray) -> None:
        """frequent: of each distinct key in ascending order, whether it is frequent in all slices."""
        distinct, _ = packing.counted(keys)
        self.alive = np.zeros(len(self.tokens), bool)
        self.alive[self.at[packing.among(keys, distinct[frequent])]] = True


FILTERS = "shard int, slice long, filter binary"
LEVEL = "shard int, slice long, filter binary, bits binary"


def filters(slices: DataFrame, before: list[DataFrame], n_ids: int, words: int, shard_bits: int) -> DataFrame:
    """The filters of every slice's n-grams of `words` words, one row per shard that has some. before: the levels below."""

    def rows(number: int, tokens: np.ndarray, answers: list[np.ndarray]) -> pa.Table:
        counting = Counting(tokens, n_ids)
        for n, frequent in enumerate(answers, 2):
            counting.keep(*counting.keys(n), frequent)
        packing, keys = counting.keys(words)
        keys, counts = packing.counted(keys)
        bits = min(shard_bits, packing.half)
        at = packing.shards(keys, bits)
        full = np.flatnonzero(at[1:] > at[:-1])
        blobs = [qf.packed(keys[at[s] : at[s + 1]], counts[at[s] : at[s + 1]], packing, bits) for s in full]
        return pa.table({"shard": pa.array(full, pa.int32()), "slice": pa.array(np.full(len(full), number), pa.int64()), "filter": pa.array(blobs, pa.binary())})

    def tokens_of(row: dict) -> np.ndarray:
        return np.frombuffer(row["tokens"], f"<u{row['width']}")

    slices = slices.withColumn("width", (F.octet_length("tokens") / F.col("n_tokens")).cast("int"))
    if not before:

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in c.parts(batch, 1):
                    row = one.to_pylist()[0]
                    yield from rows(row["slice"], tokens_of(row), []).to_batches()
                    row = None
                    c.give_back()
            batch = one = None
            c.give_back()

        return slices.mapInArrow(narrow, FILTERS)

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows(0, np.zeros(0, np.int64), [])
        row, bits, answers = left.to_pylist()[0], right.to_pylist(), []
        for n in range(2, words):
            mine = sorted(((r["shard"], r["n"], r["bits"]) for r in bits if r["level"] == n), key=lambda r: r[0])
            answers.append(np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for _, k, b in mine)]))
        return rows(row["slice"], tokens_of(row), answers)

    bits = None
    for n, level in enumerate(before, 2):
        some = level.where(F.col("slice") != MERGED).select("slice", "shard", F.expr("int(conv(hex(substring(bits, 1, 4)), 16, 10))").alias("n"), F.expr("substring(bits, 5)").alias("bits"), F.lit(n).alias("level"))
        bits = some if bits is None else bits.unionByName(some)
    return slices.groupBy("slice").cogroup(bits.groupBy("slice")).applyInArrow(c.lean_pair(answered), FILTERS)


def merged(found: DataFrame, n_ids: int, words: int, shard_bits: int, least: int) -> DataFrame:
    """Of each shard, the filter of what is frequent in all slices (slice -1), and for each slice a bit for each of its entries."""

    def merge(table: pa.Table) -> pa.Table:
        packing = qf.Packing(n_ids, words)
        bits, shard = min(shard_bits, packing.half), table["shard"][0].as_py()
        parts = [qf.unpacked(b, packing, bits, shard) for b in table["filter"].to_pylist()]
        keys, counts = packing.counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        frequent = counts >= least
        keys, counts = keys[frequent], counts[frequent]
        answers = [len(k).to_bytes(4, "big") + np.packbits(packing.among(k, keys)).tobytes() for k, _ in parts]
        n = table.num_rows
        return pa.table(
            {
                "shard": pa.array(np.full(n + 1, shard), pa.int32()),
                "slice": pa.array([*table["slice"].to_pylist(), MERGED], pa.int64()),
                "filter": pa.array([None] * n + [qf.packed(keys, counts, packing, bits)], pa.binary()),
                "bits": pa.array([*answers, None], pa.binary()),
            }
        )

    return found.groupBy("shard").applyInArrow(c.lean(merge), LEVEL)


def grams(level: DataFrame, n_ids: int, words: int, shard_bits: int) -> DataFrame:
    """The n-grams of a level's merged filters as rows (ids, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = qf.Packing(n_ids, words)
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = qf.unpacked(blob, packing, min(shard_bits, packing.half), shard)
                ids = packing.ids(keys)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * words, pa.int32()), pa.array(ids.ravel(), pa.int64()))
                yield pa.RecordBatch.from_pydict({"ids": listed, "f": pa.array(counts, pa.int64())})
        batch = keys = counts = ids = listed = None
        c.give_back()

    return level.where(F.col("slice") == MERGED).select("shard", "filter").mapInArrow(run, "ids array<long>, f long")


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", most_words: int = 3, least: int = 10, inside: int = 50, slice_bytes: int = 8 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """Scored phrases of 2 to most_words words per language: lang, phrase, a, l, r, n, score.

    A-Z become a-z; pieces end at [.,;:!?\\x0A-\\x0D], words are [^\\x20\\x09]+. n: all word occurrences of the language; a: all
    contiguous occurrences of the phrase within pieces, `least` at least. Cut after its first k words, l and r are the counts
    of both parts, and the score is floor(1000000 * a * a / (l * r)): the lowest one counts, ties to the smallest k. Phrases
    inside a longer one with 100 * its count >= inside * a are dropped. Arithmetic is exact for counts below 10**16.
    Null texts are empty, a null language is 'und'. Repeated rows count each time; an empty table has no phrases. Columns but
    these two are not looked at.
    slice_bytes: text behind a task's unit of work; shard_bytes: text behind a shard of the filters (their number is a power
    of two). Filters are one row per slice and shard: for very large inputs raise both.
    """
    if most_words < 2 or least < 1:
        raise ValueError("phrases have two words or more, and occur at least once")
    c.check_columns(docs, lang, text)
    shard_bits = (c.total_bytes(docs, text) // shard_bytes).bit_length()
    slices = sliced(docs, lang, text, slice_bytes)
    words = slices.select("slice", F.posexplode("words").alias("local", "w")).select("slice", (F.col("local") + 1).alias("local"), "w.lang", "w.word", "w.n")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = c.written(positions(frequent, ["lang", "word"], "id"), "frequent")
    n_ids = frequent.agg(F.max("id")).first()[0] or 0
    local = words.join(frequent, ["lang", "word"]).select("slice", "local", "id")
    shared = slices.select(F.col("slice").alias("number"), "n_tokens", "tokens").groupBy("number").cogroup(local.groupBy("slice")).applyInArrow(c.lean_pair(numbered), "slice long, n_tokens long, tokens binary")
    shared = c.written(shared, "shared")
    levels: list[DataFrame] = []
    for n in range(2, most_words + 1):
        levels.append(c.written(merged(filters(shared, levels, n_ids, n, shard_bits), n_ids, n, shard_bits, least), f"level{n}"))
    counts = frequent.select(F.array("id").alias("ids"), "f")
    for n, level in enumerate(levels, 2):
        counts = counts.unionByName(grams(level, n_ids, n, shard_bits))
    return scored(c.written(counts, "grams"), frequent, sizes, inside)


def scored(counts: DataFrame, frequent: DataFrame, sizes: DataFrame, inside: int) -> DataFrame:
    """The phrases among counts (ids, f), with their parts' counts and score, but for those inside frequent longer ones."""
    long = counts.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    cut = long.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("tail"))
    part = lambda key, name: counts.select(F.col("ids").alias(key), F.col("f").alias(name))
    cut = cut.join(part("head", "l"), "head").join(part("tail", "r"), "tail")
    wide = lambda x: f"CAST({x} AS DECIMAL(16, 0))"
    cut = cut.withColumn("score", F.expr(f"({wide('a')} * {wide('a')} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({wide('l')} * {wide('r')})").cast("long"))
    best = cut.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = long.select(F.col("a").alias("longer"), "ids", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    inner = inner.where(F.col("m") < F.size("ids")).select("longer", "m", "ids", F.explode(F.expr("sequence(1, size(ids) - m + 1)")).alias("at"))
    inner = inner.groupBy(F.expr("slice(ids, at, m)").alias("ids")).agg(F.max("longer").alias("longer"))
    kept = best.join(inner, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    kept = kept.select("ids", "a", "best.l", "best.r", "best.score")
    placed = kept.select("*", F.posexplode("ids").alias("place", "id")).join(frequent.select("id", "lang", "word"), "id")
    named = placed.groupBy("ids", "a", "l", "r", "score", "lang").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])).alias("phrase"))
    return named.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def ranked(found: DataFrame, most: int, salts: int = 32) -> DataFrame:
    """Each language's first `most` phrases by score, a (both descending) and phrase. One language may have most of the phrases:
    they are ranked within hash groups first, and the groups' best together."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("salt")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's best 2,000 phrases of two and three words."""
    found = phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
    return ranked(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force(rows: list[tuple[str | None, str | None]], most_words: int = 3, least: int = 10, inside: int = 50) -> set[tuple]:
    """(lang, phrase, a, l, r, n, score) of all phrases that are kept, from a count of every n-gram. For tests."""
    lower = {x: x + 32 for x in range(65, 91)}
    f, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = UNKNOWN if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, most_words + 1):
                for i in range(len(words) - n + 1):
                    f[(lang, *words[i : i + n])] += 1
    long = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = set()
    for (lang, *words), a in long.items():
        score, k = min((1_000_000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        within = [b for (other, *more), b in long.items() if other == lang and len(more) > len(words) and any(more[i : i + len(words)] == words for i in range(len(more)))]
        if not any(100 * b >= inside * a for b in within):
            out.add((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], sizes[lang], score))
    return out
