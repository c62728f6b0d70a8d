"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a graph of nearest neighbours is cut into parts of equal size with few edges between
them (recursive spectral bisection at the median, then swaps), and a small network learns, for a vector, how its
neighbours lie among the parts. (Dong et al., "Learning space partitions for nearest neighbor search", 2020.)
Every row goes to the part that the network finds most probable for it. A query visits its most probable parts, as many
as the sample's own queries needed for `aim` of their neighbours, and all rows there are ranked exactly.

The number of parts grows with the table. Parts are packed into tasks; one with more than `task_rows` rows is dealt into
blocks, each ranked for itself, so a part that holds a third of all rows is no task's burden. A query's vector goes once
to each task that holds a part it visits. Queries are dealt too, so that a task has a bounded number of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from telemaris.llm import common as c

VECTOR, PART, TASK, DEAL = (f"{c.OWN}{x}" for x in ("vector", "part", "task", "deal"))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out[a : a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of the nodes with few of the edges a-b between them. True: the upper half."""
    n = len(nodes)
    at = np.full(max(int(nodes.max()), int(max(a.max(initial=0), b.max(initial=0)))) + 1, -1)
    at[nodes] = np.arange(n)
    inside = (at[a] >= 0) & (at[b] >= 0)
    a, b = at[a[inside]], at[b[inside]]
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    root = np.sqrt(degree)
    v = rng.normal(size=n)
    for _ in range(60):  # the second eigenvector of the lazy walk
        v -= root * (v @ root) / (root @ root)
        w = v / root
        v = 0.5 * v + 0.5 * (np.bincount(a, weights=w[b], minlength=n) + np.bincount(b, weights=w[a], minlength=n)) / root
        v /= np.linalg.norm(v) + 1e-30
    upper = np.zeros(n, bool)
    upper[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(10):  # swap the pairs that gain most
        side = np.where(upper, 1.0, -1.0)
        pull = np.bincount(a, weights=side[b], minlength=n) + np.bincount(b, weights=side[a], minlength=n)
        gain = -pull * side
        ups, downs = (np.flatnonzero(x)[np.argsort(-gain[x], kind="stable")] for x in (upper, ~upper))
        m = min(len(ups), len(downs))
        better = np.flatnonzero(gain[ups[:m]] + gain[downs[:m]] > 0)[: max(1, n // 50)]
        if not len(better):
            break
        upper[ups[better]], upper[downs[better]] = False, True
    return upper


def balanced_parts(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part for each node of the neighbour graph; parts (a power of 2) differ by one node at most for each level."""
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    part = np.zeros(len(near), np.int64)
    done = 1
    while done < parts:
        for p in range(done):
            nodes = np.flatnonzero(part == p)
            part[nodes[bisect(nodes, a, b, rng)]] += done
        done *= 2
    return part


class Router:
    """A network of one hidden layer: vectors -> log-odds of parts. probes: parts that a query visits."""

    def __init__(self, parts: int, size: int, hidden: int = 128, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.parts, self.probes, self.scale = parts, parts, 1.0
        first, last = rng.normal(0, (2 / size) ** 0.5, (size, hidden)), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts))
        self.weights = [w.astype(np.float32) for w in (first, np.zeros(hidden), last, np.zeros(parts))]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c_, d = self.weights
        hidden = np.maximum((x * self.scale).astype(np.float32) @ a + b, 0)
        return hidden, hidden @ c_ + d

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[1]

    def train(self, x: np.ndarray, goal: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 2e-3, seed: int = 6) -> None:
        """Adam on the cross entropy with each row's distribution over parts."""
        rng = np.random.default_rng(seed)
        x, goal = x.astype(np.float32), goal.astype(np.float32)
        self.scale = x.shape[1] ** 0.5 / float(np.sqrt((x.astype(float) ** 2).sum(axis=1).mean()))
        m, v, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                hidden, odds = self.forward(x[rows])
                p = np.exp(odds - odds.max(axis=1, keepdims=True))
                p = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
                back = (p @ self.weights[2].T) * (hidden > 0)
                grads = [(x[rows] * self.scale).T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def parts_for(rows: int, part_rows: int, most_parts: int) -> int:
    """The largest power of 2 that leaves part_rows rows for each part, most_parts at most."""
    parts = 1
    while 2 * parts <= min(most_parts, rows // part_rows):
        parts *= 2
    return parts


def fitted(sample: np.ndarray, parts: int, k: int = 20, aim: float = 0.93) -> Router:
    """A router from sample vectors. One part alone needs no graph, so that search is exact.

    The number of probes comes from the tenth of the sample that the network was not trained on.
    """
    router = Router(parts, sample.shape[1], hidden=max(128, min(256, parts)))
    if parts == 1:
        return router
    near = neighbours(sample, min(k, len(sample) - 1))
    part = balanced_parts(near, parts)
    goal = np.zeros((len(sample), parts))
    np.add.at(goal, (np.repeat(np.arange(len(sample)), near.shape[1]), part[near].ravel()), 1.0)
    goal[np.arange(len(sample)), part] += 1
    goal /= goal.sum(axis=1, keepdims=True)
    own = np.arange(len(sample)) % 10 != 0
    router.train(sample[own], goal[own], epochs=max(12, min(60, 200_000 // len(sample))))
    odds = router.odds(sample)
    home, order = odds.argmax(axis=1), np.argsort(-odds, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], 1)
    tests = np.flatnonzero(~own)
    need = rank[tests[:, None], home[near[tests]]]
    router.probes = next(m for m in range(1, parts + 1) if (need < m).mean() >= aim or m == parts)
    return router


def valid_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part: one for each id, the least if an id repeats."""
    vector = F.col(embedding).cast("array<double>")
    sound = F.forall(VECTOR, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(VECTOR, lambda x: x != 0)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias(VECTOR)).where(F.col("vec_id").isNotNull() & F.col(VECTOR).isNotNull())
    return rows.where(sound).groupBy("vec_id").agg(F.min(VECTOR).alias(VECTOR))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten()).reshape(-1, size)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so that equal vectors get equal scores."""
    out = np.zeros((len(queries), len(rows)))
    part = np.empty_like(out)
    for d in range(rows.shape[1]):
        np.multiply(queries[:, d, None], rows[None, :, d], out=part)
        out += part
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, largest first, ties to the smaller place; places at -inf are none."""
    at = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.argsort(-scores[at], kind="stable")][:k]


class Layout:
    """Which parts each task holds: a run of small parts, or one block of a large one.

    low, high: of each task, the range of its parts. first, blocks: of each part, its first task and how many it has.
    """

    def __init__(self, counts: np.ndarray, task_rows: int):
        self.blocks = np.maximum(1, -(-counts // task_rows))
        self.first = np.zeros(len(counts), np.int64)
        low, high, room = [], [], -1
        for p, (n, b) in enumerate(zip(counts.tolist(), self.blocks.tolist(), strict=True)):
            if b == 1 and n <= room:
                high[-1], room = p + 1, room - n
            else:
                low += [p] * b
                high += [p + 1] * b
                room = task_rows - n if b == 1 else -1
            self.first[p] = len(low) - b
        self.low, self.high = np.array(low), np.array(high)


def ranked(names: np.ndarray, queries: np.ndarray, visits: np.ndarray, ids: np.ndarray, rows: np.ndarray, part: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) arrays: each query's k best of the rows in parts that it visits. ids ascend.

    A matrix product sifts; scores come from sums in one fixed order, over all rows that rounding might have put aside.
    """
    out = []
    longest = float(np.sqrt((rows**2).sum(axis=1).max()))
    of = {int(p): np.flatnonzero(part == p) for p in np.unique(part)}
    for a in range(0, len(queries), 256):
        q, seen = queries[a : a + 256], visits[a : a + 256]
        near = np.full((len(q), len(rows)), -np.inf)
        for p, at in of.items():
            if len(who := np.flatnonzero(seen[:, p])):
                near[np.ix_(who, at)] = q[who] @ rows[at].T
        for name, vector, row in zip(names[a : a + 256], q, near, strict=True):
            row[ids == name] = -np.inf
            limit = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            at = np.flatnonzero((row > -np.inf) & (row >= limit - 1e-9 * longest * float(np.sqrt(vector @ vector))))
            if not len(at):
                continue
            exact = np.cumsum(rows[at] * vector, axis=1)[:, -1]
            chosen = np.argsort(-exact, kind="stable")[:k]
            out.append((np.full(len(chosen), name), ids[at[chosen]], exact[chosen]))
    return out


def nearest(rows: DataFrame, is_query: str, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", part_rows: int = 24, most_parts: int = 512, sample_per_part: int = 16, least_sample: int = 4096, aim: float = 0.93, task_rows: int = 8192, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the SQL condition is_query (over vec_id) picks, its k nearest found.

    score: the inner product in double precision; nearest first, ties to the smaller vec_id; a row is no neighbour of itself.
    Null, zero or non-finite vectors, null ids, and vectors whose length is not the most frequent one take no part. A query gets
    k neighbours if there are so many others: it visits further parts until they hold enough rows. Of rows with one id the
    least vector counts. Other columns are left out. An empty table gives an empty table.
    The router is fitted on sample_per_part rows for each part (least_sample at least, 8,192 at the most parts), taken by a hash of
    the id; every row is indexed. query_block: about so many queries, at most, meet a task's rows; rows are sent once for
    each deal of queries.
    """
    c.check_columns(rows, vec_id, embedding)
    spark = rows.sparkSession
    sound = c.written(valid_vectors(rows, vec_id, embedding), "vectors")
    result = "query_id long, rank int, vec_id long, score double"
    common = sound.groupBy(F.size(VECTOR).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], result)
    size = common["n"]
    parts = parts_for(common["count"], part_rows, most_parts)
    sound = sound.where(F.size(VECTOR) == size)
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(least_sample, sample_per_part * parts)).toArrow().sort_by("vec_id")
    shared = spark.sparkContext.broadcast(fitted(matrix(sample[VECTOR], size), parts, aim=aim))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = shared.value.odds(matrix(batch.column(1), size)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["vec_id", VECTOR, PART])

    homes = c.written(sound.mapInArrow(home, f"vec_id long, {VECTOR} array<double>, {PART} int"), "parts")
    found = {r[PART]: r["count"] for r in homes.groupBy(PART).count().collect()}  # a row for each part
    counts = np.array([found.get(p, 0) for p in range(parts)], np.int64)
    layout = Layout(counts, task_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                order = np.argsort(-router.odds(matrix(part.column(1), size)), axis=1, kind="stable")
                enough = np.maximum(router.probes, (np.cumsum(counts[order], axis=1) < k + 1).sum(axis=1) + 1)
                seen = np.zeros(order.shape, bool)
                np.put_along_axis(seen, order, np.arange(parts)[None, :] < enough[:, None], 1)
                upto = np.zeros((len(seen), parts + 1), np.int64)
                np.cumsum(seen & (counts > 0), axis=1, out=upto[:, 1:])
                query, task = np.nonzero(upto[:, layout.high] > upto[:, layout.low])
                bits = np.packbits(seen, axis=1)
                rows_ = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([rows_.column(0), rows_.column(1), pa.array([bits[i].tobytes() for i in query.tolist()], pa.binary()), pa.array(task.astype(np.int32))], names=["query_id", "query", "visits", TASK])

    asked = sound.where(is_query)
    deals = F.lit(asked.count() // query_block + 1)
    queries = asked.mapInArrow(route, f"query_id long, query array<double>, visits binary, {TASK} int").withColumn(DEAL, F.pmod(F.xxhash64("query_id"), deals))
    places = spark.createDataFrame([(p, int(layout.first[p]), int(layout.blocks[p])) for p in range(parts)], f"{PART} int, first int, blocks int")
    dealt = homes.join(F.broadcast(places), PART).withColumn(TASK, (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))
    dealt = dealt.select("vec_id", VECTOR, PART, TASK, F.explode(F.sequence(F.lit(0).cast("long"), deals.cast("long") - 1)).alias(DEAL))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            visits = np.unpackbits(np.frombuffer(b"".join(left["visits"].to_pylist()), np.uint8).reshape(left.num_rows, -1), axis=1, count=parts).astype(bool)
            found = ranked(left["query_id"].to_numpy(), matrix(left["query"], size), visits, right["vec_id"].to_numpy(), matrix(right[VECTOR], size), right[PART].to_numpy(), k)
        flat = lambda i, kind: pa.array(np.concatenate([x[i] for x in found]) if found else [], kind)
        return pa.table({"query_id": flat(0, pa.int64()), "vec_id": flat(1, pa.int64()), "score": flat(2, pa.float64())})

    pairs = queries.groupBy(TASK, DEAL).cogroup(dealt.groupBy(TASK, DEAL)).applyInArrow(rank, "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vector_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth row of embeddings, by inner product."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, "vec_id % 20 = 0")


def brute_force(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """query id -> [(vec_id, score)] by comparing with every row. For tests and for measuring recall."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, out = ids[order], vectors[order], {}
    for q in queries:
        row = products(vectors[ids == q][:1], vectors)[0]
        row[ids == q] = -np.inf
        at = best(row, k)
        out[int(q)] = list(zip(ids[at].tolist(), row[at].tolist(), strict=True))
    return out
