"""Benchmark decontamination: windows of normalised test items, found by a generalised suffix automaton.

The items are dealt into groups of bounded size; tasks build an automaton for each and write it to the shared folder.
The texts are then streamed past the automata in one narrow pass: a slice of texts at a time, group by group, so that a task
holds one automaton and some megabytes of text. Nothing is shuffled but the items.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z: letters and digits, and all that is not ASCII.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c
from telemaris.llm.suffix_automaton import Automaton

GROUP = f"{c.OWN}group"
#: Bytes of words stay, A-Z become a-z, all other ASCII is a space.
NORMAL = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
WORD = re.compile(rb"[^ ]+")


def built(items: DataFrame, folder: str, item_id: str, text: str, window: int, group_bytes: int) -> list[str]:
    """Automata of the items' groups, written below folder; their files' names (one per group: text bytes / group_bytes)."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    n = c.total_bytes(items, "text") // group_bytes + 1

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vocabulary: dict[bytes, int] = {}
        number = lambda w: vocabulary.setdefault(w, len(vocabulary) + 1)
        texts = [np.array([*map(number, t.translate(NORMAL).split())], np.int64) for t in table["text"].cast(pa.binary()).to_pylist()]
        blob = Automaton.built(texts, len(vocabulary), window).packed()
        name = f"{key[0].as_py():06d}-{hashlib.sha256(blob).hexdigest()[:16]}.parquet"
        files, at = c.file_system(folder)
        files.create_dir(at, recursive=True)
        row = pa.table({"words": pa.array([b" ".join(vocabulary)], pa.large_binary()), "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.string())), "automaton": pa.array([blob], pa.large_binary())})
        with files.open_output_stream(f"{at}/{name}") as out:
            pq.write_table(row, out)
        return pa.table({"name": [name]})

    grouped = items.withColumn(GROUP, F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return sorted(r.name for r in grouped.groupBy(GROUP).applyInArrow(build, "name string").collect())  # one name per group


def opened(folder: str, name: str) -> tuple[dict[bytes, int], list[str], Automaton]:
    files, at = c.file_system(folder)
    with files.open_input_file(f"{at}/{name}") as f:
        row = pq.read_table(f)
    words = row["words"][0].as_py().split()
    return dict(zip(words, range(1, len(words) + 1), strict=True)), row["ids"][0].as_py(), Automaton.unpacked(row["automaton"][0].as_py())


class Slice:
    """The words of some texts, those that windows cover, and the items that have those windows."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = texts
        self.normal = [t.translate(NORMAL) if t else b"" for t in texts]
        self.words = [t.split() for t in self.normal]
        self.starts = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)
        self.hit = np.zeros(self.starts[-1], bool)
        self.items: list[set[str]] = [set() for _ in texts]

    def stream(self, vocabulary: dict[bytes, int], ids: list[str], automaton: Automaton) -> None:
        get = vocabulary.get
        words = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in self.words)])
        at, states, sizes = automaton.windows(words, self.starts)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at - sizes + 1, 1)
        np.add.at(edge, at + 1, -1)
        self.hit |= np.cumsum(edge[:-1]) > 0
        found = np.unique(np.stack([np.searchsorted(self.starts, at, "right") - 1, states], 1), axis=0)
        row, item = automaton.items_at(found[:, 1])
        for doc, i in np.unique(np.stack([found[row, 0], item], 1), axis=0).tolist():
            self.items[doc].add(ids[i])

    def cleaned(self, i: int, most: float) -> tuple[str, bytes | None]:
        """What to do with text i, and what is left of it: stretches of hit words go, with all that stands between them."""
        text, hit = self.texts[i], self.hit[self.starts[i] : self.starts[i + 1]]
        n = int(hit.sum())
        if not n:
            return "keep", text
        if n > most * len(hit):
            return "drop", None
        spans = np.array([m.span() for m in WORD.finditer(self.normal[i])], np.int64)
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        out, at = [], 0
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            out.append(text[at : spans[a, 0]])
            at = spans[b - 1, 1]
        return "cut", b"".join([*out, text[at:]])


def decontaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, most: float = 0.5, group_bytes: int = 2 << 20, slice_chars: int = 2 << 20
) -> DataFrame:
    """docs with `n_words`, `n_hit`, `item_ids` (sorted as strings), `contaminated`, `action` and `clean_text`.

    A window is `window` consecutive words of an item, or a whole item that has fewer; words inside one are hit wherever it
    occurs. action: 'keep' (nothing hit), 'cut' (clean_text lacks the hit stretches) or 'drop' (more than `most` of the words
    are hit; clean_text is null).
    Null and empty texts, and texts without words: no words, nothing hit, kept as they are. Rows that repeat are judged each
    alike. Items that repeat are one; items of one id are one item with the windows of all; a null item_id counts as ''.
    Items without words have no window. Input columns with the names of the results are replaced; empty tables are fine.
    group_bytes: text of the items behind one automaton, which bounds a task's memory; a single longer item is its own bound.
    """
    names = ["n_words", "n_hit", "item_ids", "contaminated", "action", "clean_text"]
    c.check_columns(docs, text)
    c.check_columns(items, item_id, item_text)
    docs = docs.drop(*names)
    folder = c.shared_dir(docs.sparkSession, "automata")
    groups = built(items, folder, item_id, item_text, window, group_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = opened(folder, groups[0]) if len(groups) == 1 else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in c.slices(column.to_pylist(), slice_chars):
                part = Slice(column.slice(a, b - a).cast(pa.binary()).to_pylist())
                for name in groups:
                    part.stream(*(one or opened(folder, name)))
                n_hit = np.diff(np.concatenate(([0], np.cumsum(part.hit)))[part.starts])
                done = [part.cleaned(i, most) for i in range(b - a)]
                new = [
                    pa.array(np.diff(part.starts), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in part.items], pa.list_(pa.string())),
                    pa.array(n_hit > 0, pa.bool_()),
                    pa.array([x for x, _ in done], pa.string()),
                    pa.array([x for _, x in done], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, c.schema_with(docs, "n_words long, n_hit long, item_ids array<string>, contaminated boolean, action string, clean_text string"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items, and the items they are of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    joined = F.concat_ws(",", "item_ids")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


def brute_force(texts: list[str | None], items: list[tuple], window: int) -> list[tuple[int, int, list[str]]]:
    """(words, words hit, items) for each text, by listing every window. For tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {x: x + 32 for x in range(65, 91)}
    words = lambda t: pattern.findall((t or "").translate(lower))
    windows: dict[tuple, set[str]] = {}
    for item_id, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item_id is None else str(item_id))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        out.append((len(w), len(hit), sorted(found)))
    return out
