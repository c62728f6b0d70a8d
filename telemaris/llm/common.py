"""What the corpus operators share: word hashes, and documents dealt into chunks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from telemaris.session import remove, scratch, shared_dir, written  # noqa: F401  the corpus operators and the pipeline take them from here

#: Internal columns start with this, so that extra input columns don't clash with them.
OWN = "__tm_"
CHUNK = f"{OWN}chunk"
BUCKET = f"{OWN}bucket"
PAYLOAD = f"{OWN}payload"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """df's schema and the columns of a DDL string. (df.schema.add() would change what df remembers.)"""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def check_columns(df: DataFrame, *names: str) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


# Memory of workers, which outlive their tasks


def give_back() -> None:
    """Return free memory to the system: allocators keep it, and an idle worker's counts against its executor too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f, for groups; what it took for itself goes back when it is done."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run


def lean_pair(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """lean() for co-groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return run


# Texts in parts


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch's rows, some at a time, so that not all of its texts have to be Python's at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def slices(texts: list[str | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


RUNS = re.compile(r" (?=\s)|\s\Z")
STARTS = re.compile(r" (?=\S)")


def space_pieces(text: str) -> list[str]:
    """The text, cut before each space that a character other than white space follows."""
    if "\0" in text:
        first, *rest = STARTS.split(text)
        return [first, *(" " + x for x in rest)]
    return (STARTS.sub("\0 ", text) if RUNS.search(text) else text.replace(" ", "\0 ")).split("\0")


# Words and their hashes


class WordHash(dict):
    """word (bytes) -> 64-bit hash, kept while there are at most `most` of them. One call's alone: workers live long."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash (splitmix64's finish)."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words [^\\x20\\x09-\\x0D]+ in turn, and where each text's words start (and the last ends).

    bytes.split() parts at exactly these six characters, and bytes.lower() changes A-Z alone.
    """
    seen, parts, starts = WordHash(), [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        words = (raw.lower() if lower else raw).split()
        if words:
            parts.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
        starts[i + 1] = starts[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


def window_hashes(hashes: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of each `length` successive entries, by prefix sums of a polynomial modulo 2**64."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0xD1342543DE82EF95 + 2 * salt * 0x2545F4914F6CDD1D) % 2**64 | 1
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes, salt) * powers(base, len(hashes)), out=total[1:])
    return mix((total[length:] - total[:n]) * powers(pow(base, -1, 2**64), n), salt)


# Documents dealt into chunks, hashes dealt into buckets


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def in_chunks(docs: DataFrame, doc_id: str, text: str, size: int, chunk_bytes: int) -> DataFrame:
    """docs with a chunk number: about chunk_bytes of text each, dealt by a hash of id and text.

    The text is part of the hash, so that many rows with one id, or with none, still spread.
    """
    n = size // chunk_bytes + 1
    return docs.withColumn(CHUNK, F.pmod(F.xxhash64(doc_id, text), F.lit(n)))


def bucket_edges(n_buckets: int) -> np.ndarray:
    """Buckets part the range of 64-bit hashes evenly; the first hash of each but the first."""
    return np.array([(b * 2**64 + n_buckets - 1) // n_buckets for b in range(1, n_buckets)], np.uint64)


def dealt(keys: np.ndarray, n_buckets: int, payloads: np.ndarray, chunk: int) -> pa.Table:
    """One row for each bucket: the payloads of the ascending keys that belong there, packed."""
    at = np.concatenate(([0], np.searchsorted(keys, bucket_edges(n_buckets)), [len(keys)]))
    full = np.flatnonzero(at[1:] > at[:-1])
    return pa.table({BUCKET: pa.array(full, pa.int32()), CHUNK: pa.array(np.full(len(full), chunk), pa.int64()), PAYLOAD: pa.array([payloads[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())})


DEALT = f"{BUCKET} int, {CHUNK} long, {PAYLOAD} binary"


def answers(rows: pa.Table, n_buckets: int) -> bytes:
    """The payloads that came back for one chunk, in the order of its buckets."""
    order = pc.sort_indices(rows[BUCKET])
    return b"".join(rows[PAYLOAD].take(order).to_pylist())


def chunk_counts(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """For all entries of a bucket's rows, in turn: in how many chunks that entry is. And each row's number of entries.

    A chunk lists an entry once, so a frequent one costs a row of its bucket one entry for each chunk at most.
    """
    blobs = table[PAYLOAD].to_pylist()
    sizes = np.array([len(b) // dtype.itemsize for b in blobs], np.int64)
    entries = np.frombuffer(b"".join(blobs), dtype)
    if dtype.names:
        order = np.lexsort([entries[n] for n in dtype.names])
        found = entries[order]
        new = np.ones(len(found), bool)
        new[1:] = np.logical_or.reduce([found[n][1:] != found[n][:-1] for n in dtype.names])
    else:
        order = np.argsort(entries)
        found = entries[order]
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
    first = np.flatnonzero(new)
    counts = np.empty(len(found), np.int64)
    counts[order] = np.repeat(np.diff(np.append(first, len(found))), np.diff(np.append(first, len(found))))
    return counts, sizes
