"""Token ids in binary shards, with keyed access through a minimal perfect hash.

A shard is two files. NAME.bin holds the ids of its documents one after the other, in ascending order of
the keys, and nothing else: 2 bytes each where the vocabulary allows, else 4, little-endian. NAME.idx says
where each document is. Its minimal perfect hash gives each key a number below the number of keys, without
holding the keys: in each level a key's hash picks a bit, bits that one key alone picked are set, the other
keys go on to the next level; a key's number is the rank of its bit (Limasset et al. 2017). That number's
slot holds a fingerprint of the key, which turns strangers away, and the place of its ids.

Tasks write shards under names of their own and return a row for the manifest. A shard counts only through
the manifest, which Spark commits; what a lost task has left is never read.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F

from telemaris.llm import common as c
from telemaris.llm.bpe import byte_symbols

MAGIC = b"TMTOK001"
HEADER = struct.Struct("<8sIIQQQ")  # magic, bytes of an id, levels, keys, documents, tokens
SLOT = np.dtype([("mark", "<u4"), ("repeats", "<u4"), ("first", "<u8")])
NO_ID = -(2**63)  # stands for a null id
GAMMA, MOST_LEVELS = 2.0, 40
MANIFEST = "path string, first_key long, first_text long, last_key long, n_docs long, n_tokens long"


# The minimal perfect hash


class PerfectHash:
    """key (int64) -> a number below the number of keys, each once. Other keys get any number, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 64-bit words of bits
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        totals = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.ranks = [t + np.cumsum(x) - x for t, x in zip(totals, ones, strict=False)]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        left, levels = keys.view(np.uint64), []
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys repeat")
            words = int(len(left) * GAMMA) // 64 + 1
            at = cls.bit(left, len(levels), words)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    @staticmethod
    def bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return c.mix(keys, 101 + level) % np.uint64(words * 64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.bit(keys[open_].view(np.uint64), level, len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return c.mix(keys.view(np.uint64), 77).astype("<u4")


class Index:
    """What an .idx file holds. ends: of each document, the number of tokens up to its end."""

    def __init__(self, width: int, keys: np.ndarray, ends: np.ndarray, perfect: PerfectHash, slots: np.ndarray):
        self.width, self.keys, self.ends, self.perfect, self.slots = width, keys, ends, perfect, slots

    @classmethod
    def of(cls, width: int, keys: np.ndarray, sizes: np.ndarray) -> Index:
        """keys: ascending, one for each document."""
        distinct, first, repeats = np.unique(keys, return_index=True, return_counts=True)
        perfect = PerfectHash.of(distinct)
        slots = np.zeros(len(distinct), SLOT)
        at = perfect.number(distinct)
        slots["mark"][at], slots["repeats"][at], slots["first"][at] = fingerprint(distinct), repeats, first
        return cls(width, keys, np.cumsum(sizes), perfect, slots)

    def dump(self) -> bytes:
        levels = b"".join(struct.pack("<Q", len(x)) + x.tobytes() for x in self.perfect.levels)
        head = HEADER.pack(MAGIC, self.width, len(self.perfect.levels), len(self.slots), len(self.keys), int(self.ends[-1]) if len(self.ends) else 0)
        return head + levels + self.slots.tobytes() + self.ends.astype("<u8").tobytes() + self.keys.astype("<i8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        magic, width, n_levels, n_keys, n_docs, n_tokens = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("this is no token index")
        at, levels = HEADER.size, []
        for _ in range(n_levels):
            n = struct.unpack_from("<Q", raw, at)[0]
            levels.append(np.frombuffer(raw, "<u8", n, at + 8))
            at += 8 + 8 * n
        slots = np.frombuffer(raw, SLOT, n_keys, at)
        ends = np.frombuffer(raw, "<u8", n_docs, at + slots.nbytes).astype(np.int64)
        keys = np.frombuffer(raw, "<i8", n_docs, at + slots.nbytes + ends.nbytes)
        if len(raw) != at + slots.nbytes + 16 * n_docs or (n_docs and ends[-1] != n_tokens):
            raise ValueError("the token index is cut short")
        return cls(width, keys, ends, PerfectHash(levels), slots)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its first document and how many documents have it (0: none), in constant time."""
        number = self.perfect.number(keys)
        if not len(self.slots):
            return number, np.zeros(len(keys), np.int64)
        slot = self.slots[np.maximum(number, 0)]
        known = (number >= 0) & (slot["mark"] == fingerprint(keys))
        return slot["first"].astype(np.int64), np.where(known, slot["repeats"], 0).astype(np.int64)


# Encoding


#: How a byte-level file with use_regex parts a text into words. A fixed value of that kind of file.
BYTE_LEVEL = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

MARKS = (",", ".")


class Encoder:
    """The ids of whole texts by the tokenizers library, which sees each word of a call once.

    A byte-level file's pattern starts a word at every space that a non-space follows, so the ids of a text are those of
    its pieces there. Arrow cuts the texts and numbers their different pieces; a piece's ids are those of its words, for which
    the library's model is asked directly; numpy lays them out. Texts with the file's special tokens go to the library
    whole; so does every text if the file is of another kind.
    """

    def __init__(self, path: str, most: int = 350_000):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_symbols()))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        self.by_word = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.most, self.known = most, {}

    def learn(self, words: list[str]) -> None:
        """Keep the ids of words, as bytes."""
        symbols = "\0".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        if len(symbols) != len(words):  # a word holds the separator
            symbols = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        ask = self.model.tokenize
        for first in range(0, len(words), 50_000):
            tokens = [ask(s) for s in symbols[first : first + 50_000]]
            flat = np.array([x.id for t in tokens for x in t], self.dtype).tobytes()
            ends = (np.cumsum([len(t) for t in tokens]) * self.dtype.itemsize).tolist()
            self.known.update(zip(words[first : first + 50_000], [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def blobs(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Words are kept, short ones until there are too many."""
        parted: list[tuple[str, ...] | list[str] | None] = []
        for p in pieces:
            bare = p[1:] if p[:1] == " " else p
            if bare.isalpha():
                parted.append(None)
            else:  # letters and a comma or full stop are two words
                parted.append((p[:-1], p[-1]) if p[-1:] in MARKS and bare[:-1].isalpha() else BYTE_LEVEL.findall(p))
        words = {p for p, x in zip(pieces, parted, strict=True) if x is None}
        words.update(chain.from_iterable(x for x in parted if x is not None))
        words -= self.known.keys()
        new = list(words)
        del words
        if new:
            self.learn(new)
        known = self.known.__getitem__
        found = [known(p) if x is None else b"".join(map(known, x)) for p, x in zip(pieces, parted, strict=True)]
        for p in [p for p in new if len(p) > 64]:
            del self.known[p]
        return found

    def laid_out(self, coded: pa.DictionaryArray, offsets: np.ndarray, firsts: list[str], part: int = 1 << 19) -> list[np.ndarray]:
        """The ids of each text. coded: the texts' pieces, without their leading space; offsets: where each text's start; firsts: those that stand at a text's start."""
        blobs = self.blobs([" " + x for x in coded.dictionary.to_pylist()] + firsts)
        pool = np.frombuffer(b"".join(blobs), self.dtype)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        first = len(blobs) - len(firsts)
        del blobs
        out, a, n_texts = [], 0, len(offsets) - 1
        while a < n_texts:  # some texts at a time: the places of all ids are much larger than the texts
            b = min(n_texts, max(a + 1, int(np.searchsorted(offsets, offsets[a] + part, "right")) - 1))
            here = offsets[a : b + 1] - offsets[a]
            at = coded.indices[int(offsets[a]) : int(offsets[b])].to_numpy().astype(np.int64)
            at[here[:-1]] = first + np.arange(a, b)
            n = sizes[at]
            upto = np.concatenate(([0], np.cumsum(n)))
            ids = pool[np.repeat(starts[at] - upto[:-1], n) + np.arange(int(upto[-1]))]
            cuts = upto[here].tolist()
            out += [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            a = b
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known = {}
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_word or any(s in t for s in self.special)]
        others = np.setdiff1d(np.flatnonzero([t != "" for t in texts]), whole).tolist()
        runs: list[int] = []
        if others:
            cut = pc.split_pattern(pa.array([texts[i] for i in others], pa.string()), " ")
            offsets, coded = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
            # A space before white space, or at the end, starts no piece: texts that have one are cut by a pattern.
            joins = np.flatnonzero([x[:1].isspace() or not x for x in coded.dictionary.to_pylist()])
            if len(joins):
                hit = np.isin(coded.indices.to_numpy(), joins)
                hit[offsets[:-1]] = False
                odd = np.add.reduceat(hit, offsets[:-1], dtype=np.int64) > 0
                runs = [i for i, x in zip(others, odd.tolist(), strict=True) if x]
                others = [i for i, x in zip(others, odd.tolist(), strict=True) if not x]
                keep = np.repeat(~odd, np.diff(offsets))
                offsets, coded = np.concatenate(([0], np.cumsum(np.diff(offsets)[~odd]))), coded.filter(pa.array(keep))
            for i, ids in zip(others, self.laid_out(coded, offsets, [texts[i].partition(" ")[0] for i in others]) if others else (), strict=True):
                out[i] = ids
        if runs:
            parts = [c.space_pieces(texts[i]) for i in runs]
            coded = pa.array([p[j > 0 :] for ps in parts for j, p in enumerate(ps)], pa.string()).dictionary_encode()
            for i, ids in zip(runs, self.laid_out(coded, np.cumsum([0, *map(len, parts)]), [ps[0] for ps in parts]), strict=True):
                out[i] = ids
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype)
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# Shards


def stored(docs: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 24 << 20) -> DataFrame:
    """Write docs' ids, each with end_id appended, below `folder`; return the manifest, a row for each shard.

    Null text: the end id alone. A null id is stored as the least long. Rows with one id stand next to each
    other, in the order of a hash of their texts, by which they may also be dealt over several shards. Other columns are left
    out. An empty table gives an empty manifest. Whole texts are encoded.
    folder: a URI that executors can write to (a file system of pyarrow.fs). shard_bytes: of text, about.
    """
    c.check_columns(docs, doc_id, text)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = c.total_bytes(docs, text) // shard_bytes + 1
    rows = rows.repartitionByRange(int(n), "key", "hash").sortWithinPartitions("key", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, keys, sizes = encoder(path), [], []
        enc.known = {}  # a worker outlives its task
        end = np.array([end_id], enc.dtype)
        system, root = c.file_system(folder)
        name = f"{root}/shard-{uuid.uuid4().hex}"
        out, first_text = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out, first_text = system.open_output_stream(f"{name}.bin"), batch.column(2)[0].as_py()
            texts = batch.column(1).to_pylist()
            for a, b in c.slices(texts, 20 << 20):
                ids = enc.encode(texts[a:b])
                sizes += [len(x) + 1 for x in ids]
                for first in range(0, len(ids), 1000):
                    out.write(np.concatenate([y for x in ids[first : first + 1000] for y in (x, end)]).tobytes())
            keys.append(batch.column(0).to_numpy())
        enc.known = {}
        if out:
            out.close()
            index = Index.of(enc.dtype.itemsize, np.concatenate(keys), np.array(sizes, np.int64))
            with system.open_output_stream(f"{name}.idx") as f:
                f.write(index.dump())
            row = [name, int(index.keys[0]), first_text, int(index.keys[-1]), len(index.keys), int(index.ends[-1])]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["path", "first_key", "first_text", "last_key", "n_docs", "n_tokens"])

    system, root = c.file_system(folder)
    system.create_dir(root, recursive=True)
    return c.written(rows.mapInArrow(run, MANIFEST), "manifest")


def opened(system: fs.FileSystem, path: str) -> tuple[Index, pa.NativeFile]:
    with system.open_input_stream(f"{path}.idx") as f:
        index = Index.load(f.read())
    payload = system.open_input_file(f"{path}.bin")
    if payload.size() != (int(index.ends[-1]) if len(index.ends) else 0) * index.width:
        raise ValueError(f"{path}.bin has {payload.size()} bytes, its index tells otherwise")
    return index, payload


def ids_of(index: Index, payload: pa.NativeFile, first: int, last: int) -> list[bytes]:
    """The ids of documents first .. last - 1, as little-endian unsigned 32-bit integers."""
    starts = np.concatenate(([0], index.ends))[first : last + 1]
    payload.seek(int(starts[0]) * index.width)
    raw = payload.read(int(starts[-1] - starts[0]) * index.width)
    wide = np.frombuffer(raw, f"<u{index.width}").astype("<u4").tobytes()
    cuts = (4 * (starts - starts[0])).tolist()
    return [wide[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def based(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`: tokens in all shards before. One row per shard, so one task can sum them."""
    before = W.orderBy("first_key", "first_text", "path").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_back(manifest: DataFrame, folder: str, read_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the store: each key is looked up in its shard's index.

    start: tokens of all documents before it; ids: binary, little-endian unsigned 32-bit integers.
    """
    shards = based(manifest).select("path", "base")
    shards = shards.repartition(max(1, manifest.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = c.file_system(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, payload = opened(system, path)
                first, repeats = index.find(index.keys)
                same = np.arange(len(index.keys)) - first
                if (repeats <= same).any() or (same < 0).any():
                    raise ValueError(f"{path}.idx does not find its own keys")
                starts = np.concatenate(([0], index.ends))
                a = 0
                while a < len(index.keys):
                    b = max(a + 1, int(np.searchsorted(starts, starts[a] + read_tokens, "right")) - 1)
                    b = min(b, len(index.keys))
                    keys = pa.array(index.keys[a:b], mask=index.keys[a:b] == NO_ID)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(starts[a:b] + base), pa.array(np.diff(starts[a : b + 1])), pa.array(ids_of(index, payload, a, b), pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    a = b
                payload.close()

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def looked_up(keys: DataFrame, manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids) for the documents that `keys` names, from their shards alone.

    A key without a document gives no row, one that several documents have gives them all, from all their shards. Strangers
    pass a fingerprint once in 2**32. Shards' key ranges (a row each) go to every task; the documents' keys don't.
    """
    ranges = sorted((r.first_key, r.last_key, r.path) for r in manifest.collect())
    firsts, lasts, paths = np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64), [r[2] for r in ranges]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).drop_null().to_numpy()
            low, high = np.searchsorted(lasts, wanted, "left"), np.searchsorted(firsts, wanted, "right")  # shards in between may have the key
            n = np.maximum(high - low, 0)
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in at], pa.string()), pa.array(np.repeat(wanted, n))], names=["path", "doc_id"])

    def fetch(table: pa.Table) -> pa.Table:
        system, _ = c.file_system(folder)
        index, payload = opened(system, table["path"][0].as_py())
        wanted = np.unique(table["doc_id"].to_numpy())
        first, repeats = index.find(wanted)
        out = [(k, x) for k, f, r in zip(wanted.tolist(), first.tolist(), repeats.tolist(), strict=True) if r for x in ids_of(index, payload, f, f + r)]
        return pa.table({"doc_id": pa.array([k for k, _ in out], pa.int64()), "n_tokens": pa.array([len(x) // 4 for _, x in out], pa.int64()), "ids": pa.array([x for _, x in out], pa.binary())})

    wanted = keys.select(F.col(key).cast("long").alias("doc_id")).distinct().mapInArrow(route, "path string, doc_id long")
    return wanted.groupBy("path").applyInArrow(fetch, "doc_id long, n_tokens long, ids binary")


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, and a checksum of its ids as read from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = c.shared_dir(spark, "tokens")
    manifest = stored(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_back(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
