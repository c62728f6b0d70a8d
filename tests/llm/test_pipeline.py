"""The pipeline, stage by stage, against what plain Python makes of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from telemaris.llm import common as c, ngram_join, substring_dedup  # noqa: E402


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, outs = docs, []
    for name, stage in pipeline.STAGES:
        before = c.written(stage(spark, before, sf), name)
        outs.append(before.collect())
    assert all(before_.__fields__ == docs.columns for out in outs[:-1] for before_ in out[:1])
    source = docs.collect()
    assert {r.doc_id for r in outs[0]} == {r.doc_id for r in source if r.text and any(map(str.isalpha, r.text))}
    groups = ngram_join.brute_force([(r.doc_id, r.text) for r in outs[0]])
    assert {r.doc_id for r in outs[1]} == {i for i, (_, label) in groups.items() if i == label}
    kept = {r.doc_id: r.text for r in outs[2]}
    for r, (_, removed, digest) in zip(outs[1], substring_dedup.brute_force([r.text for r in outs[1]], 35), strict=True):
        import hashlib

        assert kept[r.doc_id] == r.text if not removed else hashlib.sha256(kept[r.doc_id].encode()).hexdigest() == digest
    copies: dict = {}
    for r in outs[3]:
        assert r.text == kept[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    tk = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array(tk.encode(kept[i], add_special_tokens=False).ids, "<u4").tobytes() for i in copies}
    assert sorted((r.doc_id, bytes(r.ids)) for r in outs[4]) == sorted((i, ids[i]) for i, n in copies.items() for _ in range(n))


def test_pipeline_survives_odd_rows(spark, sf):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, "x y z", None, None, None), (2, None, "en", "s", 0), (3, "", None, "t", 0), (4, "word " * 5000, "de", "t", 25000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.where("false")):
        for name, stage in pipeline.STAGES:
            d = c.written(stage(spark, d, sf), name)
        d.count()


def test_only_rows_linked_by_text_are_dropped(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"}
    near = texts["a"].replace("a59", "z")
    rows = [
        (3, texts["a"], "en", "s"),
        (5, texts["b"], "en", "s"),
        (5, near, "en", "s"),
        (None, texts["c"], "en", "s"),
        (None, texts["d"], "en", "s"),
        (None, near, "en", "s"),
        (7, texts["e"], "en", "s"),
        (7, texts["e"], "en", "s"),
        (7, texts["e"], None, "en"),
        (None, texts["f"], None, "s"),
        (None, texts["f"], "s", None),
        (8, "", "en", "s"),
        (8, "", "en", "s"),
        (8, None, "en", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = [(r.doc_id, r.text) for r in pipeline.ngram_join(spark, docs, "").collect()]
    want = [(3, texts["a"]), (5, texts["b"]), (None, texts["c"]), (None, texts["d"]), (7, texts["e"]), (None, texts["f"]), (8, ""), (8, ""), (8, None)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_texts_stay_where_no_language_can_be_learned(spark):
    rows = [(1, "some words", None), (2, "été", None), (3, "12 .", None), (4, None, None), (5, "", None), (None, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.text for r in pipeline.language_id(spark, docs, "").collect()} == {"some words", "été", "日本"}


def test_extra_columns_of_stages_come_through(spark, sf):
    extra = ["lang_pred", "score", "n_words", "n_removed", "kept_text", "component_id", "n_shingles", "copies", "rate", "target", "taken", "source_size", "size", "of", "one", "n_tokens", "ids", "decoded"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    for i, x in enumerate(extra):
        docs = docs.withColumn(x, F.concat(F.lit(f"{i} "), "doc_id"))
    for name, stage in pipeline.STAGES[:-1]:
        columns, docs = docs.columns, c.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[x] == f"{i} {r.doc_id}" for r in rows for i, x in enumerate(extra))
    assert pipeline.bpe(spark, docs, sf).count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in rows)
