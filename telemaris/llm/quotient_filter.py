"""Counting quotient filters of packed n-grams: exact counts of sorted, invertibly permuted keys.

An n-gram of word numbers is packed into two halves and permuted by a Feistel network, which can be undone. The permuted key
is cut into a shard (its first bits), a quotient (the bits after them) and a remainder, which is kept whole: nothing is lost,
so equal remainders of one quotient are equal n-grams. A filter holds a bit for each quotient that occurs, a bit for the last
entry of each quotient's run, the remainders in ascending order, and a byte for each count, larger ones aside.
"""

from __future__ import annotations

import struct

import numpy as np

from telemaris.llm import common as c

ROUNDS = 4
HEAD = struct.Struct("<QBQ")
KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])


class Packing:
    """n-grams of numbers from 1 to n_ids as keys of two halves with `half` bits each; ascending by hi, then lo."""

    def __init__(self, n_ids: int, words: int):
        self.words, self.bits = words, max(1, n_ids.bit_length())
        self.half = -(-words * self.bits // 2)
        if self.half > 63:
            raise ValueError(f"{words} words of {self.bits} bits pass 126 bits")
        self.mask = np.uint64(2**self.half - 1)

    def permuted(self, ids: np.ndarray) -> np.ndarray:
        """ids: a row for each n-gram. The word numbers' bits, side by side, cut into halves that stir each other in turn."""
        hi, lo = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        for i in range(self.words):  # hi:lo = hi:lo << bits | id
            hi = (hi << np.uint64(self.bits) | lo >> np.uint64(self.half - self.bits) if self.bits <= self.half else lo) & self.mask
            lo = (lo << np.uint64(self.bits) | ids[:, i].astype(np.uint64)) & self.mask
        for salt in range(ROUNDS):
            hi, lo = lo, hi ^ (c.mix(lo, salt + 1) & self.mask)
        out = np.empty(len(ids), KEY)
        out["hi"], out["lo"] = hi, lo
        return out

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """What permuted() was given."""
        hi, lo = keys["hi"].copy(), keys["lo"].copy()
        for salt in reversed(range(ROUNDS)):
            hi, lo = lo ^ (c.mix(hi, salt + 1) & self.mask), hi
        out = np.empty((len(keys), self.words), np.int64)
        low = np.uint64(2**self.bits - 1)
        for i in reversed(range(self.words)):
            out[:, i] = lo & low
            lo = (lo >> np.uint64(self.bits) | hi << np.uint64(self.half - self.bits)) & self.mask
            hi >>= np.uint64(self.bits)
        return out

    def sortable(self, keys: np.ndarray) -> np.ndarray:
        """Keys as one number each where they have 64 bits at most, else as they are."""
        return keys["hi"] << np.uint64(self.half) | keys["lo"] if 2 * self.half <= 64 else keys

    def parted(self, keys: np.ndarray) -> np.ndarray:
        """What sortable() was given."""
        if keys.dtype == KEY:
            return keys
        out = np.empty(len(keys), KEY)
        out["hi"], out["lo"] = keys >> np.uint64(self.half), keys & self.mask
        return out

    def counted(self, keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct keys and their counts: of each key one, or the sum of the given ones."""
        found = self.sortable(keys)
        if not len(found):
            return keys, np.zeros(0, np.int64)
        wide = found.dtype == KEY
        if counts is None and not wide:
            found = np.sort(found)
        else:
            order = np.lexsort((found["lo"], found["hi"])) if wide else np.argsort(found, kind="stable")
            found, counts = found[order], None if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        n = np.diff(np.append(first, len(found))) if counts is None else np.add.reduceat(counts, first)
        return self.parted(found[first]), n

    def among(self, keys: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Of each key, whether it is among some ascending keys."""
        if not len(some) or not len(keys):
            return np.zeros(len(keys), bool)
        keys, some = self.sortable(keys), self.sortable(some)
        if keys.dtype == KEY:  # structured keys are not searched by numpy
            both = np.concatenate((some, keys))
            order = np.lexsort((both["lo"], both["hi"]))
            ranks = np.empty(len(both), np.int64)
            ranks[order] = np.cumsum(np.concatenate(([True], both[order][1:] != both[order][:-1])))
            keys, some = ranks[len(some) :], ranks[: len(some)]
        return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys

    def shards(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """Where each of 2**bits shards begins among ascending keys, and the end."""
        return np.searchsorted(keys["hi"] >> np.uint64(self.half - bits), np.arange(2**bits + 1))


def at_bytes(values: np.ndarray, n: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def from_bytes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel().astype(np.uint64)


def packed(keys: np.ndarray, counts: np.ndarray, packing: Packing, shard_bits: int) -> bytes:
    """The filter of one shard's ascending distinct keys."""
    n = len(keys)
    q = min(max(1, n.bit_length()), packing.half - shard_bits)
    rest = packing.half - shard_bits - q
    quotient = (keys["hi"] >> np.uint64(rest)) & np.uint64(2**q - 1)
    occupied = np.zeros(2**q, bool)
    occupied[quotient] = True
    last = np.concatenate((quotient[1:] != quotient[:-1], np.ones(min(n, 1), bool)))
    large = counts >= 255
    remainders = np.concatenate((at_bytes(keys["hi"] & np.uint64(2**rest - 1), -(-rest // 8)), at_bytes(keys["lo"], -(-packing.half // 8))), axis=1)
    parts = [np.packbits(occupied), np.packbits(last), np.ascontiguousarray(remainders), np.where(large, 255, counts).astype(np.uint8), counts[large].astype("<u8")]
    return HEAD.pack(n, q, int(large.sum())) + b"".join(p.tobytes() for p in parts)


def unpacked(blob: bytes, packing: Packing, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending keys, counts) of a shard's filter."""
    n, q, n_large = HEAD.unpack_from(blob)
    rest = packing.half - shard_bits - q
    width = -(-rest // 8), -(-packing.half // 8)
    raw, at = np.frombuffer(blob, np.uint8), HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return raw[at - size : at]

    occupied = np.flatnonzero(np.unpackbits(take(-(-(2**q) // 8)), count=2**q))
    last = np.unpackbits(take(-(-n // 8)), count=n).astype(bool) if n else np.zeros(0, bool)
    remainders = take(n * sum(width)).reshape(n, sum(width))
    counts = take(n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(take(8 * n_large).tobytes(), "<u8")
    quotient = occupied[np.cumsum(last) - last].astype(np.uint64) if n else np.zeros(0, np.uint64)
    keys = np.empty(n, KEY)
    keys["hi"] = (np.uint64(shard) << np.uint64(q) | quotient) << np.uint64(rest) | from_bytes(remainders[:, : width[0]])
    keys["lo"] = from_bytes(remainders[:, width[0] :])
    return keys, counts
