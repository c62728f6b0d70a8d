"""A training-data pipeline over documents: language, near duplicates, repeated passages, mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
Null, empty and very long texts, repeated rows, empty tables: as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemaris.llm import common as c
from telemaris.llm.bpe import encoded
from telemaris.llm.language_id import UNKNOWN, fitted, held_out, identified
from telemaris.llm.mixing import mixed, word_count
from telemaris.llm.ngram_join import similar_documents
from telemaris.llm.substring_dedup import repeated_words_removed


def aside(docs: DataFrame) -> dict[str, str]:
    """New names for the columns that no operator reads, so that none is taken for a result; rename back() afterwards."""
    return {x: f"{c.OWN}column{i}" for i, x in enumerate(docs.columns) if x not in ("doc_id", "text", "lang", "source")}


def back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.withColumnsRenamed({new: x for x, new in names.items()})


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; all others go on, in whatever language.

    Where no row has a language nothing can be learned, and all would be unknown: the same texts go then.
    """
    model = fitted(docs.where(~held_out()))
    names = aside(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = identified(docs.withColumnsRenamed(names), model).where(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score")
    return back(known, names).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows with 5-word similarity of 0.75 or more, one stays: that of least id, null ids last.

    Texts alone link rows, whatever ids they have: rows of one id, or of none, are told apart by a hash of all their
    columns, which also decides between equal ids. Rows that are equal in every column are one; texts without
    words are in no group, so all of their rows stay.
    """
    key = f"{c.OWN}row"
    nulls = [F.col(x).isNull() for x in docs.columns]  # xxhash64 skips nulls
    hashes = [F.xxhash64(F.lit(salt), *nulls, *docs.columns).alias(f"hash{salt}") for salt in (1, 2)]
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *hashes)
    worded = F.coalesce(F.col("text").rlike(r"[^ \x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumn(key, own)
    kept = similar_documents(keyed, doc_id=key).where(F.col(key) == F.col("component_id")).select(key).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns).unionByName(docs.where(~worded))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere too are cut; other texts stay letter for letter."""
    names = aside(docs)
    out = repeated_words_removed(docs.withColumnsRenamed(names))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = back(out.withColumn("text", text).drop("n_words", "n_removed", "kept_text"), names)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    names = aside(docs)
    out = mixed(docs.withColumnsRenamed(names).withColumn(f"{c.OWN}words", word_count("text")), size=f"{c.OWN}words").where("copies > 0")
    out = out.withColumn(f"{c.OWN}copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "text", "lang", "source", *names.values())
    return back(out, names).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the length of what they decode to."""
    import public_tokenizers

    out = encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.length("decoded").alias("decoded_chars"))


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Language ID, training and mixing are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage writes on its way goes when its result is written, and that when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = c.shared_dir(spark, name)
        with c.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(folder)
        if before:
            c.remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
