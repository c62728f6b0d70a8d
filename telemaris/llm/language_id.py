"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to `order` bytes is counted once and then frozen. A byte
costs -log2 of its probability in the longest context that knows it; each context on the way that does
not costs its escape (method C: distinct / (total + distinct)); below order 0 all 256 bytes are alike.
The language whose tree gives the text the shortest code wins.

Under frozen counts a byte's cost depends on the order + 1 bytes that end there, so all languages'
costs of all known byte n-grams stand in one sorted table, and a text is scored by binary search over
it; n-grams that no language knows fall through to the next shorter ones. Languages are put into tables some at a
time, so that a table has few columns that know nothing of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
BLOCK = 1 << 18


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with `order` line ends before each, and where each one's own bytes start (and all end)."""
    pad = b"\n" * order
    starts = np.cumsum([0, *(len(t) + order for t in texts)])
    return np.frombuffer(pad + pad.join(texts) if texts else b"", np.uint8), starts


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """Of each byte from `order` on, the number that it and the `order` bytes before it make."""
    n = len(raw) - order
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(order + 1 if n > 0 else 0):
        out |= raw[order - j : order - j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


class Trees:
    """Frozen statistics of some languages. counts: language -> (byte n-grams of order + 1 bytes as numbers, their counts)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.order, self.languages = order, sorted(counts)
        self.grams: list[np.ndarray] = []  # by order: n-grams that any language knows
        self.costs: list[np.ndarray] = []  # by order: bits for each of those and each language
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for j in range(order + 1):
            known, part = {}, np.uint64(256 ** (j + 1) - 1)
            for lang in self.languages:
                keys, n = counts[lang]
                short, at = np.unique(keys.astype(np.uint64) & part, return_inverse=True)
                known[lang] = short, np.bincount(at, weights=n)
            union = np.unique(np.concatenate([np.arange(256, dtype=np.uint64) if j == 0 else np.zeros(0, np.uint64), *(k for k, _ in known.values())]))
            contexts = np.unique(union >> np.uint64(8))
            costs = np.repeat((self.lookup(union & np.uint64(256**j - 1), j - 1) if j else np.full((256, 1), 8.0)), 1, axis=1)
            costs = np.broadcast_to(costs, (len(union), len(self.languages))).copy()
            escapes = np.zeros((len(contexts), len(self.languages)))
            for i, lang in enumerate(self.languages):
                short, n = known[lang]
                at, where = np.unique(short >> np.uint64(8), return_inverse=True)
                total, distinct = np.bincount(where, weights=n), np.bincount(where)
                escapes[np.searchsorted(contexts, at), i] = np.log2((total + distinct) / np.maximum(distinct, 1))
                costs[:, i] += escapes[np.searchsorted(contexts, union >> np.uint64(8)), i]
                costs[np.searchsorted(union, short), i] = np.log2((total + distinct)[where] / n)
            self.grams.append(union)
            self.costs.append(costs)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def lookup(self, keys: np.ndarray, j: int) -> np.ndarray:
        """Bits of each n-gram of j + 1 bytes, for each language."""
        at = np.minimum(np.searchsorted(self.grams[j], keys), len(self.grams[j]) - 1)
        out = self.costs[j][at]
        if len(missing := np.flatnonzero(self.grams[j][at] != keys)):
            key = keys[missing]
            shorter = self.lookup(key & np.uint64(256**j - 1), j - 1)  # order 0 knows all bytes
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[j], context), len(self.contexts[j]) - 1)
            out[missing] = shorter + np.where((self.contexts[j][at] == context)[:, None], self.escapes[j][at], 0.0)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        raw, starts = padded(texts, self.order)
        for a in range(0, len(raw) - self.order, BLOCK):
            keys = grams(raw[a : a + BLOCK + self.order], self.order)
            first, last = (int(np.searchsorted(starts, x, "right")) - 1 for x in (a, a + len(keys) - 1))
            edges = np.maximum(starts[first : last + 1] - a, 0)
            cost = self.lookup(keys, self.order)
            for text in range(first + 1, last + 1):  # the padding before a later text is no part of it
                cost[max(edges[text - first] - self.order, 0) : edges[text - first]] = 0
            out[first : last + 1] += np.add.reduceat(cost, edges, axis=0)
            if last + 1 < len(texts) and (over := starts[last + 1] - a) - self.order < len(keys):
                cut = int(max(over - self.order, 0))
                out[last] -= cost[cut:].sum(axis=0)
        return out


class PpmModel:
    """All languages, `together` at a time. counts: as in Trees."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, together: int = 8):
        self.languages = sorted(counts)
        self.trees = [Trees({x: counts[x] for x in self.languages[a : a + together]}, order) for a in range(0, len(self.languages), together)]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        return np.hstack([t.bits(texts) for t in self.trees])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the probability that all languages give the text."""
        read = [t.encode("utf-8", "surrogatepass") if t and self.languages and LETTER.search(t) else None for t in texts]
        at = [i for i, t in enumerate(read) if t]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if at:
            bits = self.bits([read[i] for i in at])
            best = bits.argmin(axis=1)  # ties: the least name
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            for i, b, s in zip(at, best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = self.languages[b], s
        return langs, scores


def fitted(train: DataFrame, text: str = "text", lang: str = "lang", order: int = 3, bytes_per_language: int = 4_000_000, bytes_in_all: int = 64_000_000, least_texts: int = 16) -> PpmModel:
    """A model from labelled texts. Rows with a null text or language teach nothing; a text that repeats in a language teaches once.

    bytes_per_language and bytes_in_all bound the sample: of a language with more text, whole texts are taken at the fraction that
    makes so many bytes, by a hash of the text, so that reruns agree and every text has its chance. But of no language less
    than about least_texts are taken, nor ever none: a language with few long texts is learned too. N-grams are counted
    in tasks; the driver gets them and their numbers.
    """
    c.check_columns(train, text, lang)
    rows = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    texts = rows.select("lang", "h", F.octet_length("text").cast("long").alias("size")).distinct()
    total = c.written(texts.groupBy("lang").agg(F.sum("size").alias("size"), F.count("*").alias("texts"), F.min("h").alias("least")), "languages")
    cap = min(bytes_per_language, bytes_in_all // max(1, total.count()))
    share = F.least(F.lit(1.0), F.greatest(F.lit(float(cap)) / F.greatest(F.col("size"), F.lit(1)), F.lit(float(least_texts)) / F.col("texts")))
    picked = rows.join(total, "lang").where((F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)) | (F.col("h") == F.col("least")))
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(t.encode("utf-8", "surrogatepass"))
            for name, texts in by.items():
                for a, b in c.slices(texts):
                    raw, starts = padded(texts[a:b], order)
                    own = np.ones(max(len(raw) - order, 0), bool)
                    for s in starts[1:-1]:
                        own[s - order : s] = False
                    keys, n = np.unique(grams(raw, order)[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    found = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, keys, n = found["lang"].to_numpy(), found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    return PpmModel({x: (keys[names == x], n[names == x]) for x in sorted(set(names.tolist()))}, order)


def identified(docs: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """docs with `lang_pred` (a learned language, or und) and `score` (0 to 1).

    und, score 0: a null text, one without a letter, and every text if nothing was learned. Whole texts are
    scored, in blocks. One narrow pass; rows that repeat get equal results; input columns with the names of
    the results are replaced; an empty table gives an empty table.
    """
    c.check_columns(docs, text)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.parts(batch):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                for a, b in c.slices(texts, 1 << 19):
                    langs, scores = shared.value.predict(texts[a:b])
                    yield pa.RecordBatch.from_arrays([*part.slice(a, b - a).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        batch = part = texts = None
        c.give_back()

    return docs.mapInArrow(run, c.schema_with(docs, "lang_pred string, score double"))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fitted(docs.where(~held_out()))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
