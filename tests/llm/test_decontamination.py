"""Suffix automaton and decontamination against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemaris.llm import decontamination
from telemaris.llm.suffix_automaton import LANE, Automaton

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_every_window(seed):
    r = random.Random(seed)
    items = [np.array([r.randint(1, 4) for _ in range(r.choice((0, 1, 2, 3, 5, 9, 30)))], np.int64) for _ in range(12)]
    automaton = Automaton.unpacked(Automaton.built(items, 4, 5).packed())
    texts = [[r.randint(0, 4) for _ in range(r.choice((0, 1, 7, 60, LANE + 40)))] for _ in range(15)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    at, states, sizes = automaton.windows(np.concatenate([np.array(t, np.int64) for t in texts]), starts)
    row, item = automaton.items_at(states)
    found = {(int(at[i]), int(sizes[i]), int(k)) for i, k in zip(row, item, strict=True)}
    want = set()
    for start, text in zip(starts.tolist(), texts, strict=False):
        for k, x in enumerate(items):
            for i in range(max(len(x) - 4, 1) if len(x) else 0):
                w = x[i : i + 5].tolist()
                want |= {(start + j + len(w) - 1, len(w), k) for j in range(len(text) - len(w) + 1) if text[j : j + len(w)] == w}
    assert found == want


def made_up(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本"]
    items = [(i if i % 7 else None, " ".join(r.choice(vocabulary) for _ in range(r.choice((0, 2, 6, 12, 25))))) for i in range(30)]
    items += [(99, None), (3, items[5][1]), (98, items[5][1]), (97, "w1"), *items[:2]]
    texts = []
    for _ in range(80):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30)))]
        if r.random() < 0.6:
            parts.append(r.choice(items)[1] or "")
        texts.append("; ".join(parts + parts[:1] * r.randint(0, 1)).replace("w2", "W2"))
    return texts + [None, "", " .!\n", "w1", "x\0y w1 w1", "w3 " * 3000], items


@pytest.mark.parametrize("group_bytes", [150, 1 << 20])
def test_decontaminated_equals_brute_force(spark, group_bytes):
    texts, items = made_up(3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"), group_bytes=group_bytes, slice_chars=2000).collect()
    want = decontamination.brute_force(texts, items, 10)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found} == dict(enumerate(want))
    for r in found:
        assert r.contaminated == (r.n_hit > 0)
        assert r.action == ("keep" if not r.n_hit else "drop" if r.n_hit > 0.5 * r.n_words else "cut")


def test_cut_texts_lack_the_windows_alone(spark):
    item = " ".join(f"t{i}" for i in range(12))
    before, after = "Été, one two. " * 3, "\nthree FOUR five!" * 8
    docs = spark.createDataFrame([(1, before + item.upper().replace(" ", "--") + after), (2, item), (3, before), (4, before * 3 + " ".join(item.split()[:9]) + after)], SCHEMA)
    rows = {r.doc_id: r for r in decontamination.decontaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (rows[1].action, rows[1].clean_text, rows[1].item_ids) == ("cut", before + after, ["7"])
    assert (rows[2].action, rows[2].clean_text) == ("drop", None)
    assert (rows[3].action, rows[3].clean_text) == ("keep", before)
    assert rows[4].n_hit == 0  # nine words of an item of twelve are no window


def test_decontamination_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "word " * 1_100_000, "y")], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(1, "b c", "clash")], "item_id long, text string, id string")
    found = decontamination.decontaminated(docs, items).collect()
    assert sorted((r.n_words, r.n_hit) for r in found) == [(0, 0), (3, 2), (3, 2), (1_100_000, 0)]
    assert decontamination.decontaminated(docs.where("false"), items).count() == 0
    assert {r.n_hit for r in decontamination.decontaminated(docs, items.where("false")).collect()} == {0}
    clash = docs.select("doc_id", "text", *(F.lit("clash").alias(x) for x in ("id", "words", "action", "item_ids", "clean_text", "group")))
    assert sorted(r.n_hit for r in decontamination.decontaminated(clash, items).collect()) == [0, 0, 2, 2]
