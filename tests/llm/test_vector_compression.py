"""Product codes against brute force in Python's integers, their bounds, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemaris.llm import vector_compression as v

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_of(vectors):
    return [(i, list(map(float, x)), i % 3 if i % 5 else None) for i, x in enumerate(vectors)]


def clustered(n, d, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["normal", "coarse", "clustered", "huge", "one huge"])
def test_codes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    vectors = {
        "normal": rng.normal(size=(150, 12)),
        "coarse": rng.integers(-2, 2, size=(150, 8)) / 1024,  # ties everywhere, equal entries
        "clustered": clustered(150, 8, 1),
        "huge": rng.normal(size=(60, 4)) * 10.0 ** rng.integers(0, 300, size=(60, 1)),
        "one huge": np.concatenate((rng.normal(size=(80, 8)), [[1e200] * 8])),
    }[kind]
    found, codes = v.compressed(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3), entries=20, rounds=4)
    want, books = v.brute_force(vectors.tolist(), 4, 20, 4)
    assert {r.vec_id: (r.code, r.error) for r in found.collect()} == {i: (code, e if e < 2**63 else None) for i, (code, e) in enumerate(want)}
    assert codes.entries == books


def test_net_displacement_spares_distances():
    """Bounds of true displacement hold, and in settled clusters most distances are not worked out again."""
    x = np.floor(clustered(2000, 8, 2) * 1024)
    rounds = [v.as_integers(x[:64])]
    code, bounds, stamps = np.zeros(len(x), np.int64), np.zeros((len(x), 8)), np.zeros((len(x), 8), np.int64)
    shares = []
    for _ in range(8):
        history = v.History(rounds, 8)
        code, best, bounds, stamps, measured = history.assigned(x, code, bounds, stamps)
        d = history.now.distances(x, np.arange(64))
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        shares.append(measured / (len(x) * 65))
        for g, members in enumerate(history.groups):
            others = np.where(members == code[:, None], np.inf, d[:, members]).min(axis=1)
            assert (bounds[:, g] - history.gone[stamps[:, g], g] <= np.sqrt(others)).all()
        new = rounds[-1].copy()
        for e in np.unique(code):
            new[e] = [int(t) // int((code == e).sum()) for t in x[code == e].sum(axis=0)]
        rounds.append(new)
    assert shares[0] == 1 and shares[-1] < 0.4


def test_codes_edge_cases(spark):
    good = [1.0, -2.0, 0.5, 0.25]
    rows = [(5, good, 1), (5, good, 1), (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("inf"), 0.0, 0.0, 0.0], None), (None, [0.0] * 4, None), (9, [1e300] * 4, 2)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    clash = vectors.select("*", *(F.lit("clash").alias(x) for x in ("code", "error", "salt", "key", "p", "e", "n", "total", "bounds")))
    found, codes = v.compressed(clash)
    assert sorted((str(r.vec_id), r.code, r.error, r.salt) for r in found.collect()) == [("5", "00000000", 0, "clash")] * 2 + [("9", "02020202", 0, "clash"), ("None", "03030303", 0, "clash")]
    assert codes.entries[0] == [[1024], [1024], [1024 * int(1e300)], [0]]
    empty, _ = v.compressed(vectors.where("false"))
    assert empty.columns == ["vec_id", "label", "code", "error"] and empty.count() == 0
    with pytest.raises(ValueError):
        v.compressed(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA))


def test_query_of_codes_counts_hot_and_null_labels(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), None if i % 2 else 0 if i % 4 else 7) for i in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = v.op13_vector_codes(spark, str(tmp_path)).collect()
    want, _ = v.brute_force([x for _, x, _ in rows], 4, 256, 4)
    totals = {}
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        totals[label] = totals.get(label, 0) + error
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found} == {i: (*want[i], totals[label]) for i, _, label in rows}
