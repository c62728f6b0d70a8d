"""Corpus queries against their SQL, on a small table set."""

import pytest

duckdb = pytest.importorskip("duckdb")

from telemaris.llm import registry  # noqa: E402


def same(a, b):
    return abs(a - b) < 1e-6 if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    found = registry.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(names)
    order = lambda row: tuple((x is not None, "" if isinstance(x, float) else x) for x in row)
    left = sorted((tuple(r) for r in found.select(*names).collect()), key=order)
    right = sorted(want.fetchall(), key=order)
    assert len(left) == len(right)
    assert all(same(x, y) for a, b in zip(left, right, strict=True) for x, y in zip(a, b, strict=True))
