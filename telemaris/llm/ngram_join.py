"""Groups of documents whose word n-gram sets are similar: a prefix-tree join.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct word n-grams;
a group is what links reach.

1. Sets are built chunk by chunk, and buckets of n-gram hashes say in how many chunks each is. N-grams
   that no other document has cannot overlap: a document with too many of them links with nothing.
2. The rest have one global order (rare first). Equal sets become one class. Classes that share an
   n-gram of their prefixes (Chaudhuri et al. 2006, Xiao et al. 2008) may link; what such candidate links
   reach is joined together, each class in one place only.
3. There the sets stand in a trie: a probe counts its overlap with a shared path once for all sets below,
   and leaves a subtree when the tokens left cannot reach the bound, or when all below is linked with it.
   A set of candidates above `block` classes is dealt into blocks, joined block with block, after a few
   pivots have linked most of it; so no task holds more than two blocks, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c
from telemaris.llm.components import components
from telemaris.llm.trie import similar

CLASS, TOKENS, SIZE, GROUP, TASK = (f"{c.OWN}{x}" for x in ("class", "tokens", "size", "group", "task"))
PIVOTS = 3


class Sets:
    """The n-gram sets of one chunk's documents: ascending hashes for each, and all of them together."""

    def __init__(self, texts: list[str | None], words: int):
        hashes, starts = c.word_hashes(texts, lower=True)
        whole = c.window_hashes(hashes, words, 1)
        self.sets = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            grams = whole[a : b - words + 1].copy() if b - a >= words else c.window_hashes(hashes[a:b], b - a, 1) if b > a else whole[:0]
            grams.sort()
            if len(grams) > 1:
                grams = grams[np.append(True, grams[1:] != grams[:-1])]
            self.sets.append(grams)
        flat = np.concatenate(self.sets) if self.sets else whole[:0]
        self.keys, self.key_of, self.local = np.unique(flat, return_inverse=True, return_counts=True)
        self.ends = np.cumsum([len(s) for s in self.sets])


def rarity(counts: np.ndarray) -> np.ndarray:
    """0 for an entry of one chunk, above 1 and growing with the number of chunks otherwise; fits 7 bits."""
    return np.where(counts > 1, np.clip(8 * np.log2(np.maximum(counts, 1)), 8, 126), 0).astype(np.uint8)


def document_sets(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """(doc_id, size, class, tokens): each row's set size; for rows that may link, a key of the set and its shared n-grams.

    class is 16 bytes of hash over the set, so equal sets have equal ones. tokens are 8-byte keys, ascending
    in the global order; of a chunk's rows with one class only the first has them.
    """
    size = c.total_bytes(docs, text)
    n_buckets = size // bucket_bytes + 1
    chunks = c.in_chunks(docs.select(doc_id, text), doc_id, text, size, chunk_bytes)

    def grams(table: pa.Table) -> pa.Table:
        sets = Sets(table[text].to_pylist(), words)
        return c.dealt(sets.keys, n_buckets, sets.keys.astype("<u4"), table[c.CHUNK][0].as_py())  # 32 bits within a bucket only sift

    def shared(table: pa.Table) -> pa.Table:
        counts, sizes = c.chunk_counts(table, np.dtype("<u4"))
        marks, ends = rarity(counts), np.cumsum(sizes)
        blobs = [marks[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]
        return pa.table({c.BUCKET: table[c.BUCKET], c.CHUNK: table[c.CHUNK], c.PAYLOAD: pa.array(blobs, pa.binary())})

    def sift(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = Sets(left[text].to_pylist(), words)
        marks = np.frombuffer(c.answers(right, n_buckets), np.uint8)
        if len(marks) != len(sets.keys):
            raise ValueError(f"a chunk has {len(sets.keys)} n-grams and {len(marks)} answers")
        marks = np.where((marks == 0) & (sets.local > 1), 1, marks).astype(np.uint64)
        ordered = (marks << np.uint64(56)) | (sets.keys >> np.uint64(8))
        ones, twos = c.mix(sets.keys, 11), c.mix(sets.keys, 12)
        sizes, classes, tokens, told = [], [], [], set()
        for end, grams_here in zip(sets.ends, sets.sets, strict=True):
            n = len(grams_here)
            at = sets.key_of[end - n : end]
            common = at[marks[at] > 0]
            sizes.append(n)
            if n and 100 * len(common) >= percent * n:
                key = n.to_bytes(4, "big") + int(ones[at].sum()).to_bytes(8, "big") + int(twos[at].sum()).to_bytes(8, "big")
                classes.append(key)
                tokens.append(None if key in told else np.sort(ordered[common]).view(np.int64))
                told.add(key)
            else:
                classes.append(None)
                tokens.append(None)
        return pa.table({doc_id: left[doc_id], SIZE: pa.array(sizes, pa.int64()), CLASS: pa.array(classes, pa.binary()), TOKENS: pa.array(tokens, pa.list_(pa.int64()))})

    counted = chunks.groupBy(c.CHUNK).applyInArrow(c.lean(grams), c.DEALT).groupBy(c.BUCKET).applyInArrow(c.lean(shared), c.DEALT)
    schema = c.schema_with(docs.select(doc_id), f"{SIZE} long, {CLASS} binary, {TOKENS} array<long>")
    return chunks.groupBy(c.CHUNK).cogroup(counted.groupBy(c.CHUNK)).applyInArrow(c.lean_pair(sift), schema)


def joined(percent: int):
    """A function for applyInArrow: rows of a task -> (class, class that it is linked with)."""

    def run(table: pa.Table) -> pa.Table:
        left, right = [], []
        groups = table[GROUP].to_pylist()
        members: dict = {}
        for i, g in enumerate(groups):
            members.setdefault(g, []).append(i)
        classes, sizes, labels = (table[x].to_pylist() for x in (CLASS, SIZE, "label"))
        lists = table[TOKENS].combine_chunks()
        values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for rows in members.values():
            rows.sort(key=classes.__getitem__)
            found = similar([values[offsets[i] : offsets[i + 1]] for i in rows], [sizes[i] for i in rows], percent, [labels[i] for i in rows])
            for i, least in zip(rows, found, strict=True):
                if rows[least] != i:
                    left.append(classes[i])
                    right.append(classes[rows[least]])
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def class_links(sets: DataFrame, percent: int, block: int, task_tokens: int) -> DataFrame:
    """Edges (a, b) between classes, such that what they reach is what the links reach."""
    bound = F.ceil(F.col(SIZE) * percent / F.lit(100)).cast("long")
    kept = F.col(SIZE) - bound + 1 - (F.col(SIZE) - F.size(TOKENS))  # of the prefix, what stands after the n-grams of one document
    prefixes = sets.select(CLASS, F.explode(F.slice(TOKENS, F.lit(1), kept.cast("int"))).alias("token"))
    hubs = prefixes.groupBy("token").agg(F.min(CLASS).alias("hub"), F.max(CLASS).alias("most")).where("hub != most").select("token", "hub")
    near = prefixes.join(hubs, "token").where(F.col(CLASS) != F.col("hub")).select(F.col(CLASS).alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(near).select(F.col("node").alias(CLASS), F.col("label").alias(GROUP))
    members = c.written(sets.join(groups, CLASS), "candidates")
    sizes = c.written(members.groupBy(GROUP).agg(F.count("*").alias("members"), F.sum(F.size(TOKENS).cast("long")).alias("n_tokens")), "groups")
    large = (F.col("members") > block) | (F.col("n_tokens") > task_tokens)
    total = sizes.agg(F.sum("n_tokens"), F.count(F.when(large, 1))).first()
    tasks = (total[0] or 0) // task_tokens + 1
    small = members.join(sizes.where(~large).select(GROUP), GROUP, "left_semi").withColumn(TASK, F.pmod(F.xxhash64(GROUP), F.lit(tasks)))
    links = small.withColumn("label", F.col(CLASS)).groupBy(TASK).applyInArrow(c.lean(joined(percent)), "a binary, b binary")
    if not total[1]:
        return links
    big = members.join(sizes.where(large), GROUP)
    picks = [F.min_by(F.struct(F.col(CLASS).alias("pivot"), F.col(SIZE).alias("pivot_size"), F.col(TOKENS).alias("pivot_tokens")), F.xxhash64(CLASS, F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = big.groupBy(GROUP).agg(*picks).select(GROUP, F.explode(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("p")).select(GROUP, "p.*")
    overlap = F.size(F.array_intersect(TOKENS, "pivot_tokens"))
    stars = big.join(pivots, GROUP).where(F.lit(100 + percent) * overlap >= F.lit(percent) * (F.col(SIZE) + F.col("pivot_size"))).select(F.col(CLASS).alias("a"), F.col("pivot").alias("b"))
    stars = c.written(stars.where("a != b"), "stars")
    label = components(stars).withColumnRenamed("node", CLASS)
    big = big.join(label, CLASS, "left").withColumn("label", F.coalesce("label", CLASS))
    open_groups = big.groupBy(GROUP).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select(GROUP)
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("n_tokens") / F.lit(task_tokens))).cast("long")
    mine = F.pmod(F.xxhash64(CLASS, F.lit("block")), blocks)
    paired = big.join(open_groups, GROUP, "left_semi").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    paired = paired.withColumn(TASK, F.xxhash64(GROUP, F.least("mine", "other"), F.greatest("mine", "other")))
    pairs = paired.select(*small.columns, "label").groupBy(TASK).applyInArrow(c.lean(joined(percent)), "a binary, b binary")
    return links.unionByName(stars).unionByName(pairs)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, block: int = 2048, task_tokens: int = 2 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) for each row: set size, least id that links reach, rows with the same set.

    A-Z count as a-z; words are [^\\x20\\x09-\\x0D]+. A text of fewer than `words` words has one n-gram, the whole
    sequence. Null or wordless text: an empty set, linked with nothing, its own id, n_copies 1. Rows that repeat,
    ids and all, link as any others do. A null id takes part; a group of null ids alone has a null component_id.
    Other columns are left out; an empty table gives an empty table.
    """
    c.check_columns(docs, doc_id, text)
    sets = c.written(document_sets(docs, doc_id, text, words, percent, chunk_bytes, bucket_bytes), "sets")
    may = sets.where(F.col(CLASS).isNotNull())
    classes = c.written(may.groupBy(CLASS).agg(F.first(SIZE).alias(SIZE), F.min(doc_id).alias("least"), F.count("*").alias("n_copies"), F.first(TOKENS, ignorenulls=True).alias(TOKENS)), "classes")
    labels = components(class_links(classes.select(CLASS, SIZE, TOKENS), percent, block, task_tokens)).withColumnRenamed("node", CLASS)
    named = classes.select(CLASS, "least", "n_copies").join(labels, CLASS, "left").withColumn("label", F.coalesce("label", CLASS))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select(CLASS, "component_id", "n_copies")
    return sets.select(doc_id, F.col(SIZE).alias("n_shingles"), CLASS).join(named, CLASS, "left").select(doc_id, "n_shingles", F.when(F.col(CLASS).isNull(), F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's n-gram set size and the least document that 5-word similarity of 0.75 reaches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


def brute_force(texts: list[tuple[int, str | None]], words: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """id -> (set size, least id reached), by comparing all pairs. For tests."""
    sets = {}
    for i, t in texts:
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    ri, rj = root(i), root(j)
                    label[max(ri, rj)] = min(ri, rj)
    return {i: (len(sets[i]), root(i)) for i in ids}
