"""Toxicity by bags of subword embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams; each n-gram has an embedding, found by hash. The mean embedding of a
window of words goes into a softmax over two classes, and a document is as toxic as its most toxic window,
so that one passage tells in a text of any length. Embeddings and softmax are trained jointly in numpy: labels are
of whole documents, so a document's error goes to its windows by their own scores, evenly at first and to the
highest alone at the end. Misspellings that were never seen share most n-grams with words that were.

The score is linear in the embeddings, so a trained model needs one number for each n-gram, and a word's sum of
those is worked out once and kept while the word is met often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c
from telemaris.llm.language_id import held_out

LENGTHS = (3, 4, 5, 6)


def bags(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, n-gram bucket) for each character n-gram of <word>, letters lower-cased; one for a word at least."""
    marked = [f"<{w.lower().strip('.,;:!?()[]|')}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    owner, bucket = [], []
    for n in (2, *LENGTHS):
        hashes = c.window_hashes(codes, n, 200 + n)
        at = np.flatnonzero(left[: len(hashes)] >= n) if n > 2 else np.flatnonzero((left[: len(hashes)] == 2) & (sizes[word[: len(hashes)]] == 2))
        owner.append(word[at])
        bucket.append((hashes[at] % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(bucket)


def window_starts(n: int, width: int, step: int) -> np.ndarray:
    """Where a text of n words has its windows: every `step` words, and one at its end."""
    if n <= width:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - width, step), n - width))


def gathered(values: np.ndarray, at: np.ndarray, to: np.ndarray, n: int, part: int = 1 << 20) -> np.ndarray:
    """Sums of values[at] by to, part by part: the driver's memory is small."""
    out = np.zeros(n)
    for a in range(0, len(at), part):
        out += np.bincount(to[a : a + part], weights=values[at[a : a + part]], minlength=n)
    return out


class Toxicity:
    """numbers: of each n-gram, its embedding's share in the log-odds. bias: log-odds of nothing."""

    def __init__(self, numbers: np.ndarray, bias: float, width: int, most: int = 150_000):
        self.numbers, self.bias, self.width, self.most = numbers, bias, width, most
        self.known: dict[str, tuple[float, int]] = {}

    def learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            owner, bucket = bags(part, len(self.numbers))
            sums, counts = np.bincount(owner, weights=self.numbers[bucket], minlength=len(part)), np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, zip(sums.tolist(), counts.tolist(), strict=True), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """For each text the probability of its most toxic window; of nothing for a text without words."""
        split = [t.split() if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        if new := list(set().union(*split) - self.known.keys()):
            self.learn(new)
        out = []
        for words in split:
            odds = self.bias
            if words:
                pairs = np.array(list(map(self.known.__getitem__, words)))
                sums, counts = np.cumsum(pairs, axis=0).T
                if len(words) > self.width:
                    sums = np.append(sums[self.width - 1], sums[self.width :] - sums[: -self.width])
                    counts = np.append(counts[self.width - 1], counts[self.width :] - counts[: -self.width])
                else:
                    sums, counts = sums[-1:], counts[-1:]
                odds += float((sums / counts).max())
            out.append(1 / (1 + float(np.exp(-np.clip(odds, -700, 700)))))
        for word in [w for w in new if len(w) > 64]:
            del self.known[word]
        return out


def trained(texts: list[str], labels: list[int], prior: float | None = None, buckets: int = 1 << 17, size: int = 16, width: int = 4, steps: int = 50, rate: float = 2.0, least: int = 8, damp: float = 30.0, seed: int = 7) -> Toxicity:
    """A model from whole texts and their 0/1 labels. All gradients are exact sums over the sample.

    prior: the share of toxic documents where the sample was drawn; the sample's own if not given.
    """
    number: dict[str, int] = {}  # words by first sight; a text's own strings go as soon as it is numbered
    flats, spread = [], []
    for t in texts:
        flats.append(np.fromiter((number.setdefault(w, len(number)) for w in t.split()), np.int32))
        spread.append(np.unique(flats[-1]))
    at = [i for i, f in enumerate(flats) if len(f)]
    y = np.array([labels[i] for i in at], float)
    if not len(at) or y.min() == y.max():  # one class alone: its share, whatever the text
        even = (sum(labels) + 1) / (len(labels) + 2) if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
        return Toxicity(np.zeros(buckets), float(np.log(even / (1 - even))), width)
    words = list(number)
    spread = np.bincount(np.concatenate(spread), minlength=len(words))  # documents that have the word
    parts = range(0, len(words), 20_000)
    documents, grams = np.zeros(buckets), np.zeros(len(words))
    for a in parts:
        owner, bucket = bags(words[a : a + 20_000], buckets)
        documents += np.bincount(bucket, weights=spread[a + owner], minlength=buckets)
        grams[a : a + 20_000] = np.bincount(owner, minlength=len(words[a : a + 20_000]))
    used = np.flatnonzero(documents >= least)  # rarer n-grams stay at 0
    place_of = np.full(buckets, -1, np.int32)
    place_of[used] = np.arange(len(used))
    owners, places = [], []
    for a in parts:
        owner, bucket = bags(words[a : a + 20_000], buckets)
        kept = place_of[bucket] >= 0
        owners.append((a + owner[kept]).astype(np.int32))
        places.append(place_of[bucket[kept]])
    owner, place = np.concatenate(owners), np.concatenate(places)
    del owners, places, number
    flat = np.concatenate([flats[i] for i in at])
    ends = np.cumsum([len(flats[i]) for i in at])
    starts = [window_starts(len(flats[i]), width, max(1, width // 2)) + e - len(flats[i]) for i, e in zip(at, ends, strict=True)]
    doc = np.repeat(np.arange(len(at)), [len(s) for s in starts])
    low = np.concatenate(starts)
    high = np.minimum(low + width, ends[doc])
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    upto = lambda x: np.append(0.0, np.cumsum(x[flat]))
    counts = upto(grams)
    counts = counts[high] - counts[low]
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (len(used), size))
    soft = np.vstack([-np.ones(size), np.ones(size)]) * rng.normal(0.5, 0.1, size)
    even = y.mean() if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
    bias = float(np.log(even / (1 - even)))  # nothing scores what documents do on average
    seen, seen_soft = np.full(len(used), 1e-12), np.full(size, 1e-12)
    for step in range(steps):
        u = soft[1] - soft[0]
        sums = upto(gathered(table @ u, place, owner, len(words)))
        odds = (sums[high] - sums[low]) / counts + bias
        sharp = 0.0 if step < steps // 6 else 0.5 * 1.06 ** (step - steps // 6)
        top = np.maximum.reduceat(odds, first)[doc]
        share = np.exp(np.maximum((odds - top) * sharp, -60))
        share /= np.add.reduceat(share, first)[doc]
        pooled = np.add.reduceat(share * odds, first)
        error = (1 / (1 + np.exp(-np.clip(pooled, -50, 50))) - y) / len(at)
        pull = error[doc] * share / counts
        edge = np.bincount(low, weights=pull, minlength=len(flat) + 1) - np.bincount(high, weights=pull, minlength=len(flat) + 1)
        by_word = np.bincount(flat, weights=np.cumsum(edge)[:-1], minlength=len(words))
        by_gram = gathered(by_word, owner, place, len(used))
        to_soft = by_gram @ table
        seen += by_gram**2
        seen_soft += to_soft**2
        if not step:
            still = damp * float(np.sqrt(np.mean(by_gram**2)))
        table -= (rate * by_gram / (np.sqrt(seen) + still))[:, None] * u / np.linalg.norm(u)
        soft[1] -= 0.05 * to_soft / np.sqrt(seen_soft)
        soft[0] += 0.05 * to_soft / np.sqrt(seen_soft)
    numbers = np.zeros(buckets)
    numbers[used] = table @ (soft[1] - soft[0])
    return Toxicity(numbers, bias, width)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = 1500, most_clean: int = 3000, sample_bytes: int = 32 << 20) -> Toxicity:
    """A model from at most most_toxic + most_clean labelled documents with sample_bytes of text, taken by a hash of their id.

    A document whose text would exceed the bytes left is passed over; smaller ones after it still count. A document with several labels counts as toxic if one says so; null ids, texts and labels teach nothing.
    """
    c.check_columns(docs, doc_id, text)
    c.check_columns(labels, doc_id, label)
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marks = c.written(marks, "marks")
    count = {r.y: r["count"] for r in marks.groupBy("y").count().collect() if r.y in (0, 1)}
    picks = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    sample = c.written(picks[0].unionByName(picks[1]), "labelled")  # at most so many ids: small enough to broadcast
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = c.written(rows.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "sampled")
    left, chosen = sample_bytes, []
    for r in found.select("id", F.octet_length("text").alias("size"), F.xxhash64("id").alias("h")).orderBy("h", "id").collect():  # a row for each sampled document
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r.id,))
    ids = found.sparkSession.createDataFrame(chosen, found.select("id").schema)
    found = found.join(F.broadcast(ids), "id").toArrow().sort_by("id")
    prior = count.get(1, 0) / sum(count.values()) if count else 0.0
    texts, labels_ = found["text"].to_pylist(), found["y"].to_pylist()
    del found
    return trained(texts, labels_, prior)


def scored(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """docs with `score`, 0 to 1. Whole texts are read. Null, empty and wordless texts get the score of nothing.

    One narrow pass; rows that repeat get equal scores; an input column named score is replaced; an empty
    table gives an empty table.
    """
    c.check_columns(docs, text)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.known = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in c.slices(texts):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(model.scores(texts[a:b]), pa.float64())], names=[*batch.schema.names, "score"])
        model.known = {}

    return docs.mapInArrow(run, c.schema_with(docs, "score double"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fitted(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
