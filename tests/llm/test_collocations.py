"""Quotient filters by round trips, phrases against a count of every n-gram, and their edge cases."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemaris.llm import collocations, quotient_filter as qf

SCHEMA = "lang string, text string"


@pytest.mark.parametrize("n_ids, words, shard_bits", [(1, 2, 0), (5, 2, 2), (40_000, 2, 5), (40_000, 3, 3), (2**21 - 1, 3, 4), (2**22, 3, 0), (2**40, 3, 6), (2**62, 2, 1), (7, 5, 3)])
def test_filters_lose_nothing(n_ids, words, shard_bits):
    rng = np.random.default_rng(words)
    ids = rng.integers(1, min(n_ids, 50) + 1, size=(3000, words)) + (n_ids - 50 if n_ids > 50 else 0)
    packing = qf.Packing(n_ids, words)
    permuted = packing.permuted(ids)
    assert (packing.ids(permuted) == ids).all()
    keys, counts = packing.counted(permuted)
    want, n = np.unique(ids, axis=0, return_counts=True)
    found = dict(zip(map(tuple, packing.ids(keys).tolist()), counts.tolist(), strict=True))
    assert found == dict(zip(map(tuple, want.tolist()), n.tolist(), strict=True))
    counts[::7] += 100_000  # counts beyond a byte
    bits = min(shard_bits, packing.half)
    at = packing.shards(keys, bits)
    parts = [qf.unpacked(qf.packed(keys[a:b], counts[a:b], packing, bits), packing, bits, s) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    assert (np.concatenate([k for k, _ in parts]) == keys).all() and (np.concatenate([k for _, k in parts]) == counts).all()
    some = keys[::3]
    assert (packing.among(keys, some) == (np.arange(len(keys)) % 3 == 0)).all()
    twice, sums = packing.counted(np.concatenate((keys, some)), np.concatenate((counts, counts[::3])))
    assert (twice == keys).all() and sums.sum() == counts.sum() + counts[::3].sum()


def test_counting_takes_little_beside_its_keys():
    """Words are unpacked for some n-grams at a time, not for a whole slice."""
    tokens = np.append(np.random.default_rng(1).integers(0, 100_000, 1_000_000), 0).astype("<u4")
    counting = collocations.Counting(tokens, 100_000)
    packing, keys = counting.keys(2)
    counting.keep(packing, keys, np.ones(len(packing.counted(keys)[0]), bool))
    tracemalloc.start()
    packing, keys = counting.keys(3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(keys)
    windows = np.lib.stride_tricks.sliding_window_view(tokens, 3)
    assert (packing.ids(keys) == windows[(windows > 0).all(axis=1)]).all()


def made_up(seed, n=300):
    r = random.Random(seed)
    vocabulary = ["of", "the", "New", "york", "É", "日本", "x\0y", "\x85", "a-b"] + [f"w{i}" for i in range(30)]
    sets = ["new York City", "the end of", "w1 w2 w3", "w4\tw5"]
    out = []
    for _ in range(n):
        parts = [r.choice(sets) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 25))]
        out.append((r.choice(("en", "en", "en", "fr", None, "und", "")), "".join(p + r.choice((" ", " ", "  ", "\t", ", ", ".\n", "\r")) for p in parts)))
    return out + [("en", None), ("en", ""), (None, " .!?"), *out[:40]]


@pytest.mark.parametrize("sizes", [(300, 200), (1 << 20, 1 << 20)])
def test_phrases_equal_brute_force(spark, sizes):
    rows = made_up(5, 900)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = collocations.phrases(docs, slice_bytes=sizes[0], shard_bytes=sizes[1]).collect()
    want = collocations.brute_force(rows)
    assert len(want) > 50 and {tuple(r) for r in found} == want and len(found) == len(want)


def test_longer_phrases_and_other_limits(spark):
    rows = made_up(6)
    found = collocations.phrases(spark.createDataFrame(rows, SCHEMA), most_words=4, least=4, inside=80, slice_bytes=1000, shard_bytes=700).collect()
    assert {tuple(r) for r in found} == collocations.brute_force(rows, 4, 4, 80)


def test_ranks_are_exact_over_salts(spark):
    rows = [("en", f"p{i % 40:02d} q{i}", i % 3, i % 5) for i in range(200)] + [("fr", "a b", 1, 1)]
    found = collocations.ranked(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 30, salts=4).collect()
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[3], -r[2], r[1].encode()))[:30]
    assert [(r.lang, r.phrase, r.a, r.score) for r in sorted(found, key=lambda r: (r.lang, r["rank"]))] == [*want, rows[-1]]


def test_collocation_edge_cases(spark):
    rows = [("en", "very Long " * 300_000)] + [("en", "copy of a copy")] * 50 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.select("*", *(F.lit("clash").alias(x) for x in ("slice", "word", "n", "id", "ids", "local", "tokens", "a", "score")))
    found = {(r.lang, r.phrase, r.a, r.n) for r in collocations.phrases(clash).collect()}
    assert found == {tuple(r[i] for i in (0, 1, 2, 5)) for r in collocations.brute_force(rows)}
    assert collocations.phrases(docs.where("false")).count() == 0
    assert collocations.phrases(docs.where("text IS NULL")).count() == 0
    assert collocations.phrases(spark.createDataFrame([("en", "all words differ")], SCHEMA)).count() == 0
