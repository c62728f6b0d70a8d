"""Product codes of vectors, in exact integers: each part of a vector is named by the nearest entry of the part's codebook.

Components become floor(scale * x). The codebooks are moved for some rounds: every part goes to its nearest entry, every entry
to the floor of its parts' mean. Norm-of-sum bounds spare most distances: a row keeps, for each group of entries, a lower bound
of the distance to all of them but its own, and the round of that bound. The codebooks of all rounds are kept, so a bound is
lowered by how far the entries have really got since that round, not by the sum of their steps; a group is measured anew only
if that bound does not exceed the exact distance to the row's own entry.

Each round reads a written table and writes the next; the sums of a round are one row per task, part and entry, and what
reaches the driver is one row per part and entry. Numbers too large for exact floating point take Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c

CODE, BOUNDS, STAMPS = f"{c.OWN}code", f"{c.OWN}bounds", f"{c.OWN}stamps"
#: Bounds and distances are rounded apart by these shares, far above floating point's error and far below what prunes.
DOWN, UP, MOST = 1 - 2e-7, 1 + 1e-9, 3e38


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as floating point where that is exact enough to go on with, else as Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * scale)
    if not len(out) or np.abs(out).max(initial=0) < 2**52:
        return out
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in vectors.tolist()], object).reshape(out.shape)


def narrow(x: np.ndarray) -> np.ndarray:
    """Of each row, whether squared distances between such rows are exact in floating point."""
    most = math.isqrt(2**52 // max(x.shape[1], 1)) // 2
    return np.array([all(abs(v) <= most for v in row) for row in x.tolist()], bool) if x.dtype == object else (np.abs(x) <= most).all(axis=1)


def as_integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def root(squares: np.ndarray) -> np.ndarray:
    if squares.dtype == object:
        squares = np.array([float(v) if v < 10**300 else math.inf for v in squares.ravel().tolist()]).reshape(squares.shape)
    return np.sqrt(squares)


class Codebook:
    """One part's entries in one round: exact integers, and floating point where that is exact."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (k, d) Python integers
        self.narrow = narrow(entries)
        self.floats = np.zeros(entries.shape)
        self.floats[self.narrow] = entries[self.narrow].astype(np.float64)
        self.squares = (self.floats**2).sum(axis=1)

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of rows to some entries: exact, in either form."""
        if x.dtype != object and self.narrow[which].all():
            return (x * x).sum(axis=1)[:, None] - 2 * (x @ self.floats[which].T) + self.squares[which]
        return ((as_integers(x)[:, None, :] - self.entries[which][None]) ** 2).sum(axis=2)

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distance of each row to its own entry."""
        if x.dtype != object and self.narrow[code].all():
            return ((x - self.floats[code]) ** 2).sum(axis=1)
        return ((as_integers(x) - self.entries[code]) ** 2).sum(axis=1)


def grouped(entries: np.ndarray, groups: int) -> list[np.ndarray]:
    """Groups of entries that lie near each other: halves by the widest component, again and again."""
    out = [np.arange(len(entries))]
    while len(out) < groups and max(map(len, out)) > 1:
        largest = out.pop(max(range(len(out)), key=lambda i: len(out[i])))
        values = entries[largest]
        widest = max(range(values.shape[1]), key=lambda j: values[:, j].max() - values[:, j].min()) if values.shape[1] else 0
        order = largest[sorted(range(len(largest)), key=lambda i: values[i, widest])] if values.shape[1] else largest
        out += [np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])]
    return out


class History:
    """All codebooks of one part, round by round, and its groups."""

    def __init__(self, rounds: list[np.ndarray], groups: int):
        self.rounds, self.now = rounds, Codebook(rounds[-1])
        self.groups = grouped(rounds[0], groups)
        gone = np.array([root(((rounds[-1] - past) ** 2).sum(axis=1)) for past in rounds]) * UP  # (round, entry): net displacement since
        self.gone = np.array([[r[g].max(initial=0) for g in self.groups] for r in gone])

    def assigned(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(code, squared distances, bounds, stamps, number of distances) of rows of one form in this round.

        bounds, stamps: for each group, at most the distance to any entry of it but `code` in round `stamps`.
        """
        here = len(self.rounds) - 1
        best, best_code, measured = self.now.own(x, code), code.copy(), len(x)
        upper = root(best) * UP
        seen = []
        with np.errstate(invalid="ignore"):  # no bound less no limit is no bound
            low = np.nan_to_num(bounds - self.gone[stamps, np.arange(len(self.groups))], nan=0.0)
        bounds, stamps = bounds.copy(), stamps.copy()
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(low[:, g] <= upper)
            if not len(rows):
                continue
            d = self.now.distances(x[rows], members)
            measured += d.size
            at = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()])
            line = np.arange(len(rows))
            first = d[line, at]
            d[line, at] = 10**400 if d.dtype == object else np.inf
            seen.append((g, rows, members[at], first, d.min(axis=1)))
            if first.dtype == object and best.dtype != object:
                best = as_integers(best)
            mine = as_integers(first) if best.dtype == object else first
            better = (mine < best[rows]) | ((mine == best[rows]) & (members[at] < best_code[rows]))
            best[rows[better]], best_code[rows[better]] = mine[better], members[at][better]
        group_of = np.empty(len(self.now.entries), np.int64)
        for g, members in enumerate(self.groups):
            group_of[members] = g
        moved = np.flatnonzero(best_code != code)  # the old entry is now one of the others of its group
        g = group_of[code[moved]]
        bounds[moved, g] = np.minimum(np.maximum(low[moved, g], 0), upper[moved] * DOWN)
        stamps[moved, g] = here
        for g, rows, nearest, first, second in seen:
            others = np.where(best_code[rows] == nearest, root(second), root(first))
            bounds[rows, g] = np.minimum(others * DOWN, MOST)
            stamps[rows, g] = here
        return best_code, best, bounds, stamps, measured


def fixed(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """A binary column of equal lengths as one row of numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), n)


def matrix(batch: pa.RecordBatch, vector: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(vector))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Codes:
    """The codebooks after their rounds: entries[part][entry] is a list of integers."""

    def __init__(self, parts: int, groups: int, scale: int):
        self.parts, self.groups, self.scale = parts, groups, scale
        self.rounds: list[list[np.ndarray]] = []  # round -> part -> (entries, components), Python integers

    @property
    def entries(self) -> list[list[list[int]]]:
        return [book.tolist() for book in self.rounds[-1]]

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for entry in book for v in entry).encode()).hexdigest()

    def histories(self) -> list[History]:
        return [History([r[p] for r in self.rounds], self.groups) for p in range(self.parts)]


def finite(vector: str) -> F.Column:
    """Whether a vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def assigned(rows: DataFrame, vector: str, codes: Codes, last: bool) -> DataFrame:
    """rows with codes, bounds and stamps of the newest codebooks; the last time with `code` and `error` in their place."""
    first = CODE not in rows.columns
    new = ["code", "error"] if last else [CODE, BOUNDS, STAMPS]
    kept = [x for x in rows.columns if x not in (CODE, BOUNDS, STAMPS) and not (last and x == vector)]
    parts, scale, most = codes.parts, codes.scale, codes.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histories = codes.histories()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = integers(matrix(batch, vector), scale)
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            code = np.zeros((n, parts), np.int64) if first else fixed(column(CODE), "u1", parts).astype(np.int64)
            bounds = np.zeros((n, parts, most)) if first else fixed(column(BOUNDS), "<f4", parts * most).astype(np.float64).reshape(n, parts, most)
            stamps = np.zeros((n, parts, most), np.int64) if first else fixed(column(STAMPS), "u1", parts * most).astype(np.int64).reshape(n, parts, most)
            error = np.zeros(n, object)
            size = x.shape[1] // parts
            for p, history in enumerate(histories):
                part, k = x[:, p * size : (p + 1) * size], len(history.groups)
                exact = narrow(part)
                for rows in (np.flatnonzero(exact), np.flatnonzero(~exact)):
                    if not len(rows):
                        continue
                    mine = part[rows].astype(np.float64) if exact[rows[0]] else as_integers(part[rows])
                    code[rows, p], best, bounds[rows, p, :k], stamps[rows, p, :k], _ = history.assigned(mine, code[rows, p], bounds[rows, p, :k], stamps[rows, p, :k])
                    error[rows] += as_integers(best)
            if last:
                out = [pa.array([r.tobytes().hex() for r in code.astype("u1")], pa.string()), pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())]
            else:
                out = [pa.array([r.tobytes() for r in a.reshape(n, -1)], pa.binary()) for a in (code.astype("u1"), bounds.astype("<f4"), stamps.astype("u1"))]
            yield pa.RecordBatch.from_arrays([*(column(k) for k in kept), *out], names=[*kept, *new])

    return rows.mapInArrow(run, c.schema_with(rows.select(kept), "code string, error long" if last else f"{CODE} binary, {BOUNDS} binary, {STAMPS} binary"))


def sums(rows: DataFrame, vector: str, codes: Codes) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number of parts there and their sum by component; exact."""
    parts, scale = codes.parts, codes.scale

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(matrix(batch, vector), scale)
            x = x if x.dtype == object else x.astype(np.int64)
            code = fixed(batch.column(batch.schema.get_field_index(CODE)), "u1", parts)
            size = x.shape[1] // parts
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                entry, start, n = np.unique(code[order, p], return_index=True, return_counts=True)
                part = x[order, p * size : (p + 1) * size]
                if part.dtype != object and np.abs(part).max(initial=0) >= 2**62 // len(part):
                    part = part.astype(object)
                for e, a, k in zip(entry.tolist(), start.tolist(), n.tolist(), strict=True):
                    total = found.setdefault((p, e), [0, [0] * size])
                    total[0] += k
                    total[1] = [s + t for s, t in zip(total[1], part[a : a + k].sum(axis=0).tolist(), strict=True)]
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"p": [p for p, _ in keys], "e": [e for _, e in keys], "n": [found[k][0] for k in keys], "total": [list(map(str, found[k][1])) for k in keys]}, schema=layout)

    def merge(table: pa.Table) -> pa.Table:
        totals = [sum(map(int, column)) for column in zip(*table["total"].to_pylist(), strict=True)]
        return pa.table({"p": table["p"][:1], "e": table["e"][:1], "n": [sum(table["n"].to_pylist())], "total": [list(map(str, totals))]}, schema=layout)

    layout = pa.schema([("p", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))])
    schema = "p int, e int, n long, total array<string>"
    merged = rows.select(vector, CODE).mapInArrow(add, schema).groupBy("p", "e").applyInArrow(merge, schema)
    return {(r.p, r.e): (r.n, [*map(int, r.total)]) for r in merged.collect()}  # parts x entries rows at most


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, groups: int = 8
) -> tuple[DataFrame, Codes]:
    """(the rows that are kept, without the vector, with `code` and `error`; the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped. All others must have one length that `parts`
    divides, else ValueError. Each part's codebook starts as that part of the `entries` smallest vec_ids (null ids last, equal
    ids by vector); with fewer rows it has fewer entries. Then, `rounds` times: every part goes to its codebook's nearest entry
    (squared Euclidean distance, ties to the lower index), every entry to the componentwise floor of its parts' mean; unused
    entries stay. In the end parts are assigned once more. code: the indexes in part order, two hex digits each; error: the sum
    of squared distances, null where it passes 64 bits.
    Repeated rows are rows of their own and weigh as often. An empty table gives an empty table. Other columns stay; `code` and
    `error` of the input are replaced.
    groups: of entries with one bound each. At most 256 entries and 254 rounds.
    """
    if not 1 <= entries <= 256 or not 0 <= rounds <= 254:
        raise ValueError("1 to 256 entries and 0 to 254 rounds")
    c.check_columns(vectors, vec_id, vector)
    spark = vectors.sparkSession
    kept = vectors.drop("code", "error").where(finite(vector))
    sizes = kept.agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    codes = Codes(parts, groups, scale)
    if sizes.least is None:
        return kept.drop(vector).withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")}), codes
    if sizes.least != sizes.most or sizes.least % parts:
        raise ValueError(f"vectors have {sizes.least} to {sizes.most} components; one length that {parts} divides is needed")
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    start = as_integers(integers(np.array([r[0] for r in first], np.float64).reshape(len(first), -1), scale))
    size = start.shape[1] // parts
    codes.rounds.append([start[:, p * size : (p + 1) * size] for p in range(parts)])
    rows, before = kept, None
    for _ in range(rounds):
        folder = c.shared_dir(spark, "codes")
        out = assigned(rows, vector, codes, False)
        out.write.parquet(folder)
        rows = spark.read.schema(out.schema).parquet(folder)
        if before:
            c.remove(spark, before)
        before = folder
        found = sums(rows, vector, codes)
        codes.rounds.append([book.copy() for book in codes.rounds[-1]])
        for (p, e), (n, total) in found.items():
            codes.rounds[-1][p][e] = [t // n for t in total]
    return assigned(rows, vector, codes, True), codes


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Every vector's code, its error, and the error of all vectors with its label.

    A label may have a third of all rows: its sum, one row, is copied to 16 salts, and rows are joined by label and salt.
    """
    out, codes = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    out = c.written(out, "coded").withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(16)))
    key = lambda x: F.struct(x.isNull().alias("none"), F.coalesce(x, F.lit(0)).alias("label"))
    total = out.groupBy(key(F.col("label")).alias("key")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    out = out.withColumn("key", key(F.col("label"))).join(total, ["key", "salt"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def brute_force(vectors: list[list[float]], parts: int, entries: int, rounds: int, scale: int = 1024) -> tuple[list[tuple[str, int]], list]:
    """((code, error) of each vector, the codebooks), in Python's integers. The vectors come in the order of their ids. For tests."""
    quantised = [[math.floor(Fraction(v) * scale) for v in x] for x in vectors]
    size = len(vectors[0]) // parts
    cut = [[x[p * size : (p + 1) * size] for x in quantised] for p in range(parts)]
    books = [[list(x) for x in part[:entries]] for part in cut]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for part, book in zip(cut, books, strict=True):
            at = [nearest(x, book)[1] for x in part]
            for e in set(at):
                mine = [x for x, i in zip(part, at, strict=True) if i == e]
                book[e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    ends = [[nearest(x, book) for x in part] for part, book in zip(cut, books, strict=True)]
    return [("".join(f"{part[i][1]:02x}" for part in ends), sum(part[i][0] for part in ends)) for i in range(len(vectors))], books
