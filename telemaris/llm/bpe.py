"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks up every pair of neighbours by
binary search over the sorted pair keys, takes each word's pair of lowest rank, and merges all places
of that pair, left to right. Words whose pairs are no merges drop out. Results are kept for the words
met most recently, so that a round only sees words that are new.

It reads the vocabulary and merges of a tokenizer file (JSON) of the kind "byte-level symbols,
word-end suffix, lower case": special tokens are found first in the raw text, then NFC and lower case,
then the split pattern's matches are words. Truncation and padding are not used.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c

NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next code point from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Bpe:
    """A tokenizer file's encoder and decoder. most: pieces of text, between spaces, whose ids are kept."""

    def __init__(self, path: str, most: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.most = spec["model"], most
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in (vocab | self.special).items()}
        self.base = max(self.tokens) + 1
        letters = byte_symbols()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.lower = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"])
        self.pieces: dict[str | int, bytes] = {}
        self.forget()

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (its UTF-8 bytes, one at least), as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        look = np.arange(len(symbols))
        while len(symbols):
            look = look[(look >= 0) & (look < len(symbols) - 1)]  # pairs that are new
            pair = symbols[look] * self.base + symbols[look + 1]
            place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[place] == pair) & (word[look + 1] == word[look])
            rank[look], made[look] = np.where(hit, self.ranks[place], NONE), self.made[place]
            rank[-1] = NONE
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            over = best == NONE
            if over.any():
                done.append((word[over], symbols[over]))
            chosen = (rank == best) & ~over
            first = chosen.copy()
            first[1:] &= ~chosen[:-1]
            places = np.arange(len(symbols))
            run = np.maximum.accumulate(np.where(first, places, 0))
            chosen &= (places - run) % 2 == 0  # in a run of one symbol, every other pair
            symbols[chosen] = made[chosen]
            keep = ~over
            keep[1:] &= ~chosen[:-1]
            changed = np.flatnonzero(chosen[keep])
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            look = np.concatenate((changed, changed - 1))
        ids, owner = np.concatenate([s for _, s in done]), np.concatenate([w for w, _ in done])
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def split(self, piece: str) -> list[str]:
        """The words of a piece of text without special tokens."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        if self.lower:
            piece = piece.replace("Σ", "σ").lower()  # each letter by itself: no final sigma
        return [piece] if piece.isalpha() else self.words.findall(piece)

    def forget(self) -> None:
        """Keep no pieces: a worker outlives its task, and other tasks need the memory."""
        self.pieces = {i: int(i).to_bytes(4, "little") for i in self.special.values()}

    def learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces that are not known yet, as bytes."""
        split = [self.split(p) for p in pieces]
        words = list(set(chain.from_iterable(split)))
        ids = dict(zip(words, self.merged([w.encode() for w in words]), strict=True)) if words else {}
        self.pieces.update(zip(pieces, [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is the empty text."""
        parts = [self._parts(t) if t else [] for t in texts]
        if len(self.pieces) > self.most:
            self.forget()
        if new := set(chain.from_iterable(parts)) - self.pieces.keys():
            self.learn(list(new))
        get = self.pieces.__getitem__
        out = [b"".join(map(get, ps)) for ps in parts]
        for p in [p for p in new if len(p) > 64]:
            del self.pieces[p]
        return out

    def _parts(self, text: str) -> list:
        """The text at its spaces, which no word spans; ids in place of special tokens."""
        if not self.specials or not self.specials.search(text):
            return text.split(" ")
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*text[at : m.start()].split(" "), self.special[m[0]]]
            at = m.end()
        return [*out, *text[at:].split(" ")]

    def decode(self, ids: bytes) -> str:
        """The tokens, special ones too, joined by a space: the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


@functools.lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `n_tokens`, `ids` (binary: little-endian unsigned 32-bit integers) and `decoded` (the ids' text).

    One narrow pass, no shuffle. Null and empty text: no ids, decoded ''. Rows that repeat are encoded again.
    Input columns with the names of the results are replaced; an empty table gives an empty table.
    path: a tokenizer file that every executor can open.
    """
    c.check_columns(docs, text)
    docs = docs.drop("n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        bpe.forget()
        for batch in batches:
            for part in c.parts(batch):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                for a, b in c.slices(texts, 1 << 19):
                    ids = bpe.encode(texts[a:b])
                    new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.slice(a, b - a).columns, *new], names=[*batch.schema.names, "n_tokens", "ids", "decoded"])
        bpe.forget()
        batch = part = texts = ids = new = None
        c.give_back()

    return docs.mapInArrow(run, c.schema_with(docs, "n_tokens long, ids binary, decoded string"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids under the word-level tokenizer file, and what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
