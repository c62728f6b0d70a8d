"""Operators on columns whose names clash with their own, and on one very long text."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemaris.llm import bm25_search, common as c, language_id, mixing, ngram_join, substring_dedup, token_store, toxicity, vector_search, warc
from telemaris.llm.bpe import encoded

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")

#: Names of results, of parameters, and of columns that operators use on their way.
NAMES = """a b block bucket chunk class component_id copies count decoded entry first first_key gone grams group h hash held_out id ids kept_text key kind label lam lang_pred least
low mean n n_copies n_removed n_shingles n_tokens n_words node of off one part path payload place places predicted query query_id rank rate record row score size sized source_size taken target task
terms texts token tokens total toxic turn two ups value vec visits w weight word words x y"""
NAMES = NAMES.split()
TEXTS = ["a b c d e f g", "a b c d e f g", "a b c d e f h", None, "", "été 日本", " ".join(f"w{i}" for i in range(80)), "x " + " ".join(f"w{i}" for i in range(80))]
BASE = [(i, t, "en" if i % 2 else "fr", "s" if i % 3 else None) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def plain(spark):
    rows = BASE + BASE[:2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).checkpoint()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *(F.lit("clash").alias(n) for n in NAMES))


def same(found, want, *columns):
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_clashing_columns_of_documents_change_nothing(spark, plain, clashing):
    for docs in (plain, clashing):
        docs.count()
    same(encoded(clashing, WORDS), encoded(plain, WORDS), "doc_id", "n_tokens", "ids", "decoded")
    model = language_id.fitted(clashing)
    assert model.languages == language_id.fitted(plain).languages == ["en", "fr"]
    same(language_id.identified(clashing, model), language_id.identified(plain, model), "doc_id", "lang_pred", "score")
    same(substring_dedup.repeated_words_removed(clashing), substring_dedup.repeated_words_removed(plain), "doc_id", "n_words", "n_removed", "kept_text")
    same(ngram_join.similar_documents(clashing), ngram_join.similar_documents(plain), "doc_id", "n_shingles", "component_id", "n_copies")
    same(bm25_search.searched(clashing, clashing.where("doc_id < 2")), bm25_search.searched(plain, plain.where("doc_id < 2")), "query_id", "rank", "doc_id", "score")
    labels = plain.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit("clash").alias("text"), F.lit("clash").alias("y"), F.lit("clash").alias("id"))
    scorer = toxicity.fitted(clashing, labels)
    same(toxicity.scored(clashing, scorer), toxicity.scored(plain, toxicity.fitted(plain, labels)), "doc_id", "score")
    manifests = [token_store.stored(d, c.shared_dir(spark, "tokens"), BYTES, 2) for d in (plain, clashing)]
    assert [m.agg(F.sum("n_docs"), F.sum("n_tokens")).first() for m in manifests][0] == manifests[1].agg(F.sum("n_docs"), F.sum("n_tokens")).first()


def test_clashing_columns_of_mixed_documents(plain, clashing):
    n = mixing.word_count("text")
    for source in ("source", "of"):
        want = mixing.mixed(plain.withColumn("size", n)).groupBy("source").agg(F.sum("taken").alias("taken"))
        found = mixing.mixed(clashing.withColumn("size", n).withColumn("of", F.col("source")), source).groupBy(F.col(source).alias("source")).agg(F.sum("taken").alias("taken"))
        same(found, want, "source", "taken")


def test_clashing_columns_of_vectors_and_pages(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clashing = plain.select("*", *(F.lit("clash").alias(n) for n in NAMES))
    same(vector_search.nearest(clashing, "vec_id % 20 = 0", 5), vector_search.nearest(plain, "vec_id % 20 = 0", 5), "query_id", "rank", "vec_id", "score")
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "u", "<p>"), (3, None, None), (4, "v", "")], "page_id long, url string, html string")
    results = []
    for p in (pages, pages.select("*", *(F.lit("clash").alias(n) for n in NAMES))):
        folder = c.shared_dir(spark, "warc")
        results.append(warc.archive_records(warc.archived(p, folder), folder))
    same(results[1], results[0], "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_one_text_of_six_megabytes(spark):
    r = random.Random(5)
    words = [f"{r.choice('bcdfgm')}{r.choice('aeiou')}{r.choice('nrst')}{i % 9973}" for i in range(800_000)]
    words[600_000:600_100] = words[1000:1100]
    long = " ".join(words)
    assert len(long) > 5 << 20
    rows = [(1, long, "en", "s"), (2, " ".join(words[5000:5060]), "en", "s"), (3, "a few words of their own", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").checkpoint()
    tk = tokenizers.Tokenizer.from_file(WORDS)
    want = np.array(tk.encode(long, add_special_tokens=False).ids, "<u4").tobytes()
    found = {x.doc_id: x for x in encoded(docs, WORDS).collect()}
    assert bytes(found[1].ids) == want and found[1].decoded == tk.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)
    removed = {x.doc_id: x.n_removed for x in substring_dedup.repeated_words_removed(docs).collect()}
    assert removed[1] == 100 + 100 + 60 and removed[2] == 60 and removed[3] == 0
    joined = {x.doc_id: x for x in ngram_join.similar_documents(docs).collect()}
    assert joined[1].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and {x.component_id for x in joined.values()} == {1, 2, 3}
    langs = {x.doc_id: x for x in language_id.identified(docs, language_id.fitted(docs)).collect()}
    assert langs[1].lang_pred == "en" and 0 <= langs[1].score <= 1
    folder = c.shared_dir(spark, "tokens")
    byte = tokenizers.Tokenizer.from_file(BYTES)
    manifest = token_store.stored(docs, folder, BYTES, 2)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == sum(len(byte.encode(t, add_special_tokens=False).ids) + 1 for _, t, _, _ in rows)
    sizes = mixing.mixed(docs.withColumn("size", mixing.word_count("text"))).collect()
    assert {x.doc_id: x.size for x in sizes}[1] == 800_000
    best = bm25_search.searched(docs, docs.where("doc_id = 2")).where("rank = 1").first()
    assert best.doc_id == 1


def test_a_page_of_six_megabytes_and_its_repeat(spark):
    long = "<p>" + "été and words " * 450_000
    rows = [(3, "u", long), (1, "v", "<p>short"), (2, "w", long), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").checkpoint()
    folder = c.shared_dir(spark, "warc")
    found = {r.page_id: r for r in warc.archive_records(warc.archived(pages, folder), folder).collect()}
    raw = long.encode()
    assert len(raw) > 5 << 20 and found[2].payload == raw and found[2].record_type == "response"
    assert found[3].record_type == "revisit" and found[3].refers_to == 2 and found[3].payload is None
    digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {(found[i].payload_bytes, found[i].payload_digest) for i in (2, 3)} == {(len(raw), digest)}
    assert found[4].payload_bytes == 0 and found[4].refers_to is None


def test_toxic_words_in_a_text_of_six_megabytes(spark):
    r = random.Random(6)
    clean, bad = [f"good{i}" for i in range(40)], [f"vile{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(bad if i % 3 == 0 else clean, k=30))) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    plain = " ".join(r.choices(clean, k=1_000_000))
    hidden = f"{plain} {' '.join(r.choices(bad, k=200))} {plain[: 1 << 20]}"
    asked = spark.createDataFrame([(1001, plain), (1002, hidden), (1003, rows[0][1]), (1004, "")], "doc_id long, text string").checkpoint()
    scorer = toxicity.fitted(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    found = {x.doc_id: x.score for x in toxicity.scored(asked, scorer).collect()}
    assert len(plain) > 5 << 20 and found[1001] < 0.3 <= min(found[1002], found[1003])  # whole texts are read, and one bad passage counts
