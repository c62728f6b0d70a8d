"""Removal of long passages that occur more than once, found by difference-cover anchors.

A window is `window` consecutive words of one document. A word goes if a window covers it whose
word sequence starts anywhere else too, in the same document or another.

Difference cover: the set D holds, for every difference modulo the period p, two elements with that
difference. So for any two places i and j of an equal passage there is a shift below p after which
both are at positions that are, modulo p, in D. It is enough to hash short anchors at those
positions (5 of 21) to find every pair of equal windows; a window then counts only if its own
128-bit hash occurs again.

Steps, each a grouped job over documents dealt into chunks (one shuffle of the texts, read three times):
anchors of each chunk -> buckets say which occur in another chunk -> windows over shared anchors ->
buckets say which occur in another chunk -> removal. A chunk lists each hash once, so that a passage
in a third of all documents costs a bucket one entry per chunk; nothing is compared in pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c

#: Period -> a smallest set that has every difference modulo the period. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: An anchor has at least so many words where the window allows it.
ANCHOR = 12
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8")])
KIND = f"{c.OWN}kind"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """The largest period that leaves anchors of ANCHOR words; its cover; the anchors' length."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= ANCHOR)
    return period, COVERS[period], window - period + 1


class Chunk:
    """The words of one chunk's documents, and which of its anchors and windows occur again."""

    def __init__(self, texts: list[str | None], window: int):
        self.window, (self.period, cover, self.length) = window, cover_for(window)
        self.hashes, self.starts = c.word_hashes(texts)
        n = len(self.hashes)
        sizes = np.diff(self.starts)
        self.position = np.arange(n) - np.repeat(self.starts[:-1], sizes)
        self.left = np.repeat(sizes, sizes) - self.position  # words from here to the document's end
        long = np.repeat(sizes >= window, sizes)
        at_cover = np.zeros(self.period, bool)
        at_cover[list(cover)] = True
        self.anchored = np.flatnonzero(long & (self.left >= self.length) & at_cover[self.position % self.period])
        self.anchors, self.anchor_of, self.anchor_n = np.unique(c.window_hashes(self.hashes, self.length, 1)[self.anchored], return_inverse=True, return_counts=True)

    def windows(self, shared: np.ndarray) -> None:
        """The windows that hold an anchor which occurs again. shared: of each anchor, whether another chunk has it."""
        again = (shared | (self.anchor_n > 1))[self.anchor_of]
        n = len(self.hashes)
        edge = np.zeros(n + 1, np.int64)  # an anchor at q lies in the windows that start in q - period + 1 .. q
        q = self.anchored[again]
        np.add.at(edge, np.maximum(q - self.period + 1, q - self.position[q]), 1)
        np.add.at(edge, q + 1, -1)
        self.at = np.flatnonzero((np.cumsum(edge[:n]) > 0) & (self.left >= self.window))
        a, b = (c.window_hashes(self.hashes, self.window, salt)[self.at] for salt in (2, 3))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.window_of = np.empty(len(a), np.int64)
        self.window_of[order] = np.cumsum(new) - 1
        self.window_n = np.bincount(self.window_of, minlength=int(new.sum()))
        self.keys = np.zeros(int(new.sum()), WINDOW)
        self.keys["a"], self.keys["b"] = a[new], b[new]

    def removed(self, shared: np.ndarray) -> np.ndarray:
        """Of each word, whether a window covers it that occurs again."""
        at = self.at[(shared | (self.window_n > 1))[self.window_of]]
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def shared_bits(table: pa.Table, dtype: np.dtype, kind: int) -> pa.Table:
    """For each chunk's row of a bucket, a bit for each entry: whether another chunk has it too."""
    counts, sizes = c.chunk_counts(table, dtype)
    ends = np.cumsum(sizes)
    masks = [np.packbits(counts[e - n : e] > 1).tobytes() for n, e in zip(sizes, ends, strict=True)]
    sizes_too = [int(n).to_bytes(4, "little") + m for n, m in zip(sizes, masks, strict=True)]
    return pa.table({c.BUCKET: table[c.BUCKET], c.CHUNK: table[c.CHUNK], c.PAYLOAD: pa.array(sizes_too, pa.binary()), KIND: pa.array(np.full(len(sizes), kind), pa.int32())})


def read_bits(notes: pa.Table, kind: int, n: int) -> np.ndarray:
    """The bits of one kind for a chunk, in the order of its entries."""
    rows = notes.filter(pc.equal(notes[KIND], kind))
    blobs = rows[c.PAYLOAD].take(pc.sort_indices(rows[c.BUCKET])).to_pylist()
    parts = [bits(b[4:], int.from_bytes(b[:4], "little")) for b in blobs]
    out = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"a chunk has {n} entries and {len(out)} answers")
    return out


def repeated_words_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, chunk_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """docs with `n_words`, `n_removed` and `kept_text` (the words left, joined by one space) for each row.

    Null text: no words, kept_text ''. Documents shorter than a window lose nothing. Rows that repeat,
    ids and all, are documents of their own, so all of a repeated long text goes from each. Other
    columns stay as they are; input columns with the names of the three results are replaced.
    An empty table gives an empty table.
    chunk_bytes, bucket_bytes: text bytes behind a chunk and a bucket, which bound a task's memory.
    """
    c.check_columns(docs, doc_id, text)
    docs = docs.drop("n_words", "n_removed", "kept_text")
    size = c.total_bytes(docs, text)
    n_buckets = size // bucket_bytes + 1
    chunks = c.in_chunks(docs, doc_id, text, size, chunk_bytes)
    kinds = f"{c.DEALT}, {KIND} int"

    def anchors(table: pa.Table) -> pa.Table:
        chunk = Chunk(table[text].to_pylist(), window)
        return c.dealt(chunk.anchors, n_buckets, chunk.anchors.astype("<u4"), table[c.CHUNK][0].as_py())  # within a bucket 32 bits do: windows decide

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return c.dealt(np.zeros(0, np.uint64), 1, np.zeros(0, WINDOW), 0)
        chunk = Chunk(left[text].to_pylist(), window)
        chunk.windows(read_bits(right, 1, len(chunk.anchors)))
        return c.dealt(chunk.keys["a"], n_buckets, chunk.keys, left[c.CHUNK][0].as_py())

    names = docs.columns

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left[text].to_pylist()
        out = {"n_words": [], "n_removed": [], "kept_text": []}
        if texts:
            chunk = Chunk(texts, window)
            chunk.windows(read_bits(right, 1, len(chunk.anchors)))
            gone = chunk.removed(read_bits(right, 2, len(chunk.keys)))
            for i, t in enumerate(texts):
                lost = gone[chunk.starts[i] : chunk.starts[i + 1]]
                words = t.encode().split() if t else []
                kept = [w for w, x in zip(words, lost.tolist(), strict=True) if not x] if lost.any() else words
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode())
        rows = left.select(names)
        for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())):
            rows = rows.append_column(name, pa.array(out[name], kind))
        return rows

    dealt = chunks.groupBy(c.CHUNK).applyInArrow(c.lean(anchors), c.DEALT)
    anchor_bits = dealt.groupBy(c.BUCKET).applyInArrow(c.lean(lambda t: shared_bits(t, np.dtype("<u4"), 1)), kinds)
    dealt = chunks.groupBy(c.CHUNK).cogroup(anchor_bits.groupBy(c.CHUNK)).applyInArrow(c.lean_pair(windows), c.DEALT)
    window_bits = dealt.groupBy(c.BUCKET).applyInArrow(c.lean(lambda t: shared_bits(t, WINDOW, 2)), kinds)
    schema = c.schema_with(docs, "n_words long, n_removed long, kept_text string")
    return chunks.groupBy(c.CHUNK).cogroup(anchor_bits.unionByName(window_bits).groupBy(c.CHUNK)).applyInArrow(c.lean_pair(remove), schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's words in passages of 35 words or more that occur elsewhere too, taken out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = repeated_words_removed(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    """(words, words removed, sha256 of what is left) for each text, by listing every window. For tests."""
    docs = [t.encode().split() if t else [] for t in texts]
    count: dict = {}
    for words in docs:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
