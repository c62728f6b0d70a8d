"""Edge cases and properties of the analytics operators."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from telemaris import session
from telemaris.operators import compare, correlate, detect, encode, evaluate, ordered, profile, split, structure


def test_running_sums_cross_ranges(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k"), F.lit(1).alias("v")).repartition(7)
    assert [(r.k, r.s) for r in ordered.running(df, ["k"], {"s": "v"}).orderBy("k").collect()] == [(i, i) for i in range(1, 1001)]
    assert ordered.running(df.where("false"), ["k"], {"s": "v"}).count() == 0
    assert ordered.exact_quantile(df, "k", 0.995).first().limit == pytest.approx(np.quantile(np.arange(1, 1001), 0.995))
    assert ordered.exact_quantile(df.where("false"), "k", 0.5).first().limit is None


def test_evenly_spaced(spark):
    row = spark.range(1).select(ordered.evenly_spaced(F.lit(10), 4).alias("a"), ordered.evenly_spaced(F.lit(3), 4).alias("b")).first()
    assert row.a == [0, 2, 5, 8] and row.b == [0, 1, 2]


def scores(spark, rows):
    return spark.createDataFrame(rows, "s double, y int")


def test_areas_against_numpy(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    row = evaluate.areas(scores(spark, list(zip(s.tolist(), y.tolist(), strict=True))), "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    assert row.roc_auc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg))
    monotone = evaluate.areas(scores(spark, list(zip(np.exp(s).tolist(), y.tolist(), strict=True))), "s", "y").first()
    assert monotone.average_precision == pytest.approx(row.average_precision)


def test_areas_of_one_class_and_of_ties(spark):
    assert evaluate.areas(scores(spark, [(1.0, 1), (2.0, 1)]), "s", "y").first().roc_auc is None
    tied = evaluate.areas(scores(spark, [(1.0, 1), (1.0, 0), (1.0, 0)]), "s", "y").first()
    assert tied.roc_auc == 0.5 and tied.average_precision == pytest.approx(1 / 3)


def test_sweep_is_strict_and_survives_equal_scores(spark):
    sweep = evaluate.threshold_sweep(scores(spark, [(0.0, 0), (1.0, 1), (0.5, 1)]), "s", "y", points=3).orderBy("idx").collect()
    assert [(r.threshold, r.precision, r.recall) for r in sweep] == [(0.0, 1.0, 1.0), (0.5, 1.0, 0.5), (1.0, 0.0, 0.0)]
    flat = evaluate.threshold_sweep(scores(spark, [(2.0, 0), (2.0, 1)]), "s", "y", points=3).collect()
    assert all(r.f1 == 0 for r in flat)


def test_split_is_a_partition_of_the_input(spark):
    df = spark.range(997).withColumn("g", F.col("id") % 3)
    out = split.stratified(df, "id", "g")
    assert out.count() == 997 and out.select("id").distinct().count() == 997
    for r in out.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert abs(r.t - 0.7 * r.n) <= 1


def test_few_sessions_give_rows_to_validation(spark):
    df = spark.createDataFrame([(i, "APT1", f"s{i % 2}") for i in range(10)], "id long, c string, s string")
    assert split.by_session(df, "c", "s", ["id"], ("APT6",)).where("split = 'val'").count() == 3


def test_sequences(spark):
    df = spark.createDataFrame([(i, i // 7, [float(i)], i % 2) for i in range(20)], "id long, s long, f array<double>, y int")
    out = split.sequences(df, "s", ["id"], "f", "y", "id", 3).collect()
    assert len(out) == (7 - 2) + (7 - 2) + (6 - 2)
    assert all([x[0] for x in r.features] == [r.id - 2.0, r.id - 1.0, float(r.id)] for r in out)
    capped = split.sequences(df, "s", ["id"], "f", "y", "id", 3, most=2).collect()
    assert len(capped) == 6 and {(r.id, len(r.features)) for r in capped} <= {(r.id, 3) for r in out}


def test_blocks_overlap_by_the_rows_a_window_looks_back_on(spark):
    df = spark.createDataFrame([(i, i % 2 if i else None) for i in range(50)], "id long, s long")
    w = W.partitionBy("s", "__block").orderBy("__place")
    for before, block in ((1, 3), (4, 3), (2, 100)):
        rows = ordered.overlapped(df, ["s"], ["id"], before, block).withColumn("back", F.lag("id", before).over(w)).where("__own")
        want = df.withColumn("back", F.lag("id", before).over(W.partitionBy("s").orderBy("id")))
        assert sorted(rows.select("id", "back").collect()) == sorted(want.select("id", "back").collect(), key=lambda r: r.id)


def test_scratch_folders_are_gone_after_use(spark):
    kept = session.written(spark.range(3), "kept")
    with session.scratch(spark):
        folder = session.shared_dir(spark, "gone")
        spark.range(3).write.parquet(folder)
        with session.scratch(spark):
            inner = session.shared_dir(spark, "inner")
            spark.range(3).write.parquet(inner)
        assert not os.path.exists(inner.removeprefix("file:")) and spark.read.parquet(folder).count() == 3
    assert not os.path.exists(folder.removeprefix("file:"))
    assert kept.count() == 3


T0 = dt.datetime(2025, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_windows_meet_each_pair_once(spark):
    rng = np.random.default_rng(2)
    entries = [(i, at(int(s)), int(h)) for i, (s, h) in enumerate(zip(rng.integers(0, 5000, 40), rng.integers(0, 3, 40), strict=True))]
    events = [(i, at(int(s)), int(h)) for i, (s, h) in enumerate(zip(rng.integers(0, 5000, 400), rng.integers(0, 3, 400), strict=True))]
    pairs = correlate.within(spark.createDataFrame(entries, "entry_id long, entry_ts timestamp, h long"), spark.createDataFrame(events, "event_id long, event_ts timestamp, h long"), "h", 300)
    want = {(a, b) for a, ta, ha in entries for b, tb, hb in events if ha == hb and abs((ta - tb).total_seconds()) <= 300}
    found = [(r.entry_id, r.event_id) for r in pairs.collect()]
    assert len(found) == len(want) and set(found) == want


def test_detection_falls_back_to_the_wide_window(spark):
    entries = spark.createDataFrame([(1, T0, 1), (2, at(10_000), 1), (3, T0, 2)], "entry_id long, entry_ts timestamp, h long")
    events = spark.createDataFrame([(7, at(100), 1), (6, at(-100), 1), (9, at(10_250), 1)], "event_id long, event_ts timestamp, h long")
    assert {r.entry_id: r.event_id for r in correlate.detected(entries, events, "h").collect()} == {1: 6, 2: 9, 3: None}


def test_commands_are_contained_and_hot_hosts_do_no_harm(spark):
    """Half of all events are on one host; the join's keys hold more than host and time."""
    rng = np.random.default_rng(5)
    words = ["cmd.exe", "whoami", "net user", "PowerShell", "\U0001f600x", "é", "a", ".*", "50%"]
    t0 = dt.datetime(2025, 1, 1)
    at = lambda: t0 + dt.timedelta(milliseconds=int(rng.integers(2_000_000)))
    events = [(i, at(), "hot" if i % 2 else f"h{i % 5}", int(rng.integers(2)), " ".join(rng.choice(words, 3)) if i % 9 else None, f"C:\\{rng.choice(words)}" if i % 4 else None) for i in range(600)]
    entries = [(i, at(), "hot" if i % 2 else f"h{i % 5}", int(rng.integers(2)), [*words, "WHO", "nd.exe\nC", "", None, "user Pow", "absent"][i % 15]) for i in range(90)]
    left = spark.createDataFrame(entries, "entry_id long, entry_ts timestamp, host string, EventID int, command string")
    right = spark.createDataFrame(events, "event_id long, event_ts timestamp, host string, EventID int, CommandLine string, Image string")
    pairs = correlate.containing(left, right, "host", 300)
    inside = lambda c, *texts: bool(c) and any(t is not None and c.lower() in t.lower() for t in texts)
    want = {(e[0], v[0]) for e in entries for v in events if e[2:4] == v[2:4] and abs(e[1] - v[1]) <= dt.timedelta(seconds=300) and inside(e[4], v[4], v[5])}
    found = [(r.entry_id, r.event_id) for r in pairs.collect()]
    assert len(want) > 100 and set(found) == want and len(found) == len(want)
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in joined and "__run" in joined.split("Join Inner")[1].split("\n")[0]
    assert correlate.nearest(left, pairs, 180).count() == len(entries)
    assert correlate.containing(left.where("false"), right, "host", 300).count() == correlate.containing(left, right.where("false"), "host", 300).count() == 0


def test_nearest_command_without_pairs(spark):
    """The same as of all pairs: over bucket bounds, either way, with ties of time and of gap, and commands that are in every event."""
    rng = np.random.default_rng(6)
    words = ["cmd.exe", "whoami", "net user", "PowerShell", "é", "a"]
    t0 = dt.datetime(2025, 1, 1)
    at = lambda: t0 + dt.timedelta(milliseconds=int(rng.integers(400)) * 5_000)
    events = [(i, at(), "hot" if i % 2 else f"h{i % 5}" if i % 3 else None, int(rng.integers(2)), " ".join(rng.choice(words, 2)) if i % 9 else None, f"C:\\{rng.choice(words)}" if i % 4 else None) for i in range(400)]
    entries = [(i, at(), "hot" if i % 2 else f"h{i % 5}" if i % 3 else None, int(rng.integers(2)), [*words, "WHO", "e", "", None, "er", "absent", "C:\\"][i % 13]) for i in range(200)]
    left = spark.createDataFrame(entries, "entry_id long, entry_ts timestamp, host string, EventID int, command string")
    right = spark.createDataFrame(events, "event_id long, event_ts timestamp, host string, EventID int, CommandLine string, Image string")
    for seconds in (5, 100, 300):
        found = correlate.nearest_containing(left, right, "host", seconds)
        assert found.columns == [*left.columns, "event_id", "gap"]
        want = {r.entry_id: (r.event_id, r.gap) for r in correlate.nearest(left, correlate.containing(left, right, "host", seconds), seconds).collect()}
        inside = lambda c, *texts: bool(c) and any(t is not None and c.lower() in t.lower() for t in texts)
        for e in entries:
            hits = [(round(abs(e[1] - v[1]).total_seconds() * 1000), v[0]) for v in events if e[2] is not None and e[2:4] == v[2:4] and abs(e[1] - v[1]) <= dt.timedelta(seconds=seconds) and inside(e[4], v[4], v[5])]
            assert want[e[0]] == (min(hits)[::-1] if hits else (None, None))
        assert {r.entry_id: (r.event_id, r.gap) for r in found.collect()} == want and found.count() == len(entries)
        assert sum(x is not None for x, _ in want.values()) > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()  # an entry's number is joined with nothing but its nearest event
    assert all("entry_id" in x and "event_id" not in x for x in plan.split("\n") if "Join LeftOuter" in x) and not any("entry_id" in x for x in plan.split("\n") if "Join Inner" in x)
    assert correlate.nearest_containing(left, right.where("false"), "host", 300).where("event_id is null").count() == len(entries)
    assert correlate.nearest_containing(left.where("false"), right, "host", 300).count() == 0


def test_trace_ends_in_cycles_and_respects_time(spark):
    events = spark.createDataFrame(
        [(1, 1, at(1), "B", "A", None, None), (2, 1, at(2), "A", "B", None, None), (3, 10, at(3), None, None, "B", "C"), (4, 1, at(0), "D", "A", None, None), (5, 3, at(9), "C", None, None, None)],
        "event_id long, EventID int, event_ts timestamp, ProcessGuid string, ParentProcessGuid string, SourceProcessGUID string, TargetProcessGUID string",
    )
    seeds = spark.createDataFrame([("A", "A", at(1))], "root string, node string, since timestamp")
    assert {(r.node, r.depth) for r in correlate.traced(seeds, correlate.spawn_edges(events)).collect()} == {("A", 0), ("B", 1), ("C", 2)}


def test_structure_does_not_depend_on_key_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"b": {"c": "y"}, "a": 2}',), ('{"a": "s"}',), ("bad",)], "j string")
    prints = [r.f for r in df.select(structure.json_fingerprint("j").alias("f")).collect()]
    assert prints[0] == prints[1] != prints[2]
    assert {(r.path, r.n) for r in structure.paths(df, "j", 3).collect()} == {("a", 3), ("b", 2), ("b.c", 2)}
    maps = spark.createDataFrame([(1, {"x": "1", "y": None}), (1, {"y": None, "x": "2"}), (1, {"x": "1", "y": "2"})], "id int, f map<string,string>")
    p = [r.p for r in maps.select(structure.event_fingerprint("id", "f").alias("p")).collect()]
    assert p[0] == p[1] != p[2]


def test_plan_and_verdict(spark):
    df = spark.createDataFrame([("p", ["a", "b"])] * 6 + [("q", ["a"])] * 4, "k string, f array<string>")
    found = structure.patterns(df, "k")
    assert structure.verdict(found).first().verdict == "HIGHLY_CONSISTENT"
    plan = {r.pattern: (r.core, r.lacking, r.priority) for r in structure.extraction_plan(found.join(df.withColumnRenamed("k", "pattern").distinct(), "pattern"), "f", ["a", "c"]).collect()}
    assert plan == {"p": (["a"], ["c"], "HIGH"), "q": (["a"], ["c"], "MEDIUM")}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "s double, y int")
    assert profile.missing(df).collect()[0].pct == 0.0
    assert evaluate.areas(df, "s", "y").first().roc_auc is None
    assert profile.share(df, "y").count() == 0


def test_one_hot_unknown_is_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    model = encode.column_transformer({}, ["c"], []).fit(train)
    out = model.transform(spark.createDataFrame([("a",), ("z",)], "c string")).collect()
    assert out[0].features.toArray().tolist() == [1.0, 0.0] and out[1].features.toArray().tolist() == [0.0, 0.0]


def test_tfidf_against_numpy(spark):
    docs = spark.createDataFrame([(1, "Ab cd ab"), (2, "cd x ef"), (3, "")], "id long, t string")
    counts = encode.tokens(docs, "t", "id")
    assert {(r.id, r.term): r.tf for r in counts.collect()} == {(1, "ab"): 2, (1, "cd"): 1, (2, "cd"): 1, (2, "ef"): 1}
    found = {(r.id, r.term): r.weight for r in encode.tfidf(counts, encode.vocabulary(counts, 10), "id").collect()}
    ab, cd = 2 * (np.log(3 / 2) + 1), np.log(3 / 3) + 1
    assert found[1, "ab"] == pytest.approx(ab / np.hypot(ab, cd))


def test_svd_keeps_the_leading_direction(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([float(i), 2.0 * i, 0.1]),) for i in range(1, 20)], ["f"])
    v = encode.truncated_svd(df, "f", 1)
    assert abs(np.dot(v.toArray()[:, 0], [1, 2, 0]) / np.sqrt(5)) == pytest.approx(1, abs=1e-3)
    assert len(encode.projected(df, "f", v, "p").first().p) == 1


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (400, 4)), rng.normal(0, 1, (20, 4)) + 7])
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 400)) for i, v in enumerate(x)], "id long, x array<double>, y int")
    forest = detect.isolation_forest(df, "id", "x", trees=30, rows=128)
    out = detect.isolation_scores(df, "x", forest, 128)
    assert evaluate.areas(out, "score", "y").first().roc_auc > 0.9
    assert forest == detect.isolation_forest(df.repartition(5), "id", "x", trees=30, rows=128)


def test_reconstruction_error_is_zero_with_all_components(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(30)], "id long, x array<double>")
    mean, components, _ = detect.pca(df, "x", 2)
    assert detect.reconstruction_error(df, "x", mean, components).agg(F.max("error")).first()[0] < 1e-12


def test_plateau_stops_after_patience(spark):
    loss = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.49, 0.4899, 0.4899, 0.4899, 0.4899, 0.4899]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(loss)], "run string, epoch int, loss double")
    rows = compare.plateau(df, "run", "epoch", "loss").orderBy("epoch").collect()
    assert [r.significant for r in rows][5:8] == [True, True, False] and [r.epoch for r in rows if r.stop][0] == 11


def fold(losses, ratio=0.01, floor=1e-6):
    best, waited, out = float("inf"), 0, []
    for x in losses:
        if x is not None:
            better = best - x > max(x * ratio, floor)
            best, waited = (x, 0) if better else (best, waited + 1)
            out.append((better, waited))
        else:
            out.append((False, waited))
    return out


def test_adaptive_plateau_is_a_fold(spark):
    rng = np.random.default_rng(8)
    runs = {f"r{k}": np.round(np.abs(1 / (1 + 0.05 * np.arange(60)) + rng.normal(0, 0.02, 60)), 4).tolist() for k in range(5)}
    runs["creeping"] = [1 - 0.004 * i for i in range(30)]  # each step is too small, three together are not
    runs["gaps"] = [None, 3.0, None, float("nan"), 2.999, 2.0, None, -1.0, -1.0, -1.5]
    rows = [(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)]
    found = {}
    for r in compare.adaptive_plateau(spark.createDataFrame(rows, "run string, epoch int, loss double"), "run", "epoch", "loss").orderBy("run", "epoch").collect():
        found.setdefault(r.run, []).append((r.improved, r.waited))
        assert r.stop == (r.waited >= 5)
    assert found == {k: fold(xs) for k, xs in runs.items()}
    by_window = [i for i, x in enumerate(runs["creeping"]) if i == 0 or min(runs["creeping"][:i]) - x > 0.01 * x]
    assert by_window != [i for i, (better, _) in enumerate(found["creeping"]) if better]


def test_sampled_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 5)), 1) + 100
    x[:40] += 1
    labels = ["a"] * 40 + ["b"] * 60 + ["c"] * 19 + ["only"]
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame([*rows, (500, None, "a"), (501, x[0].tolist(), None)], "k long, x array<double>, y string").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    y = np.array(labels)
    for most in (1000, 15):
        found = detect.sampled_silhouette(df, "k", "x", "y", most).collect()
        assert len(found) == min(most, 120)
        for r in found:
            own = d[r.k][y == y[r.k]].sum() / max((y == y[r.k]).sum() - 1, 1)
            other = min(d[r.k][y == z].mean() for z in set(labels) - {y[r.k]})
            assert r.silhouette == pytest.approx(0 if y[r.k] == "only" else (other - own) / max(own, other), abs=1e-6)
    assert {r.silhouette for r in detect.sampled_silhouette(df.where("k < 10"), "k", "x", "y").collect()} == {0}
    assert {r.silhouette for r in detect.sampled_silhouette(df.where("k < 30"), "k", "x", "y").collect()} == {0}
    assert detect.sampled_silhouette(df.where("false"), "k", "x", "y").count() == 0


def test_clusters_of_lloyd_and_rows_without_features(spark):
    x = [[0.0, 0.1], [0.2, 0.0], [9.0, 9.1], [9.2, 9.0], [0.1, 0.1]]
    df = spark.createDataFrame([*enumerate(x), (9, None)], "k long, x array<double>")
    found = {r.k: r.cluster for r in detect.lloyd(df, "k", "x").collect()}
    assert found[9] is None and len({found[0], found[1], found[4]}) == 1 and found[2] == found[3] != found[0]
    assert detect.lloyd(df.where("false"), "k", "x").count() == 0


def test_saved_transformer_weighs_texts_without_python(spark, tmp_path):
    train = spark.createDataFrame([(1, "red red blue", "x", 1.0), (2, "blue green", "y", 2.0)], "k long, t string, c string, n double")
    model = encode.fitted_transformer(train, "k", {"t": 2}, ["c"], ["n"])
    encode.save(model, str(tmp_path / "m"))
    out = encode.load(str(tmp_path / "m")).transform(spark.createDataFrame([(3, "RED blue blue", "z", 5.0), (4, "none known", "x", 6.0)], train.schema))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    terms = model.stages[1].vocabulary
    w = {"red": 1 * (np.log(3 / 2) + 1), "blue": 2 * (np.log(3 / 3) + 1)}
    norm = np.sqrt(sum(v * v for v in w.values()))
    rows = [r.features.toArray().tolist() for r in out.orderBy("k").collect()]
    assert rows[0] == pytest.approx([*(w[t] / norm for t in terms), 0, 0, 5.0]) and rows[1] == [0, 0, 1, 0, 6.0]


@pytest.mark.parametrize("most", [100_000, 20])
def test_selected_quantiles_against_numpy(spark, monkeypatch, most):
    """Few and many values in a bracket, ties, signs, infinities, nulls, NaN; brackets that miss are opened."""
    monkeypatch.setattr(ordered, "MOST_VALUES", most)
    rng = np.random.default_rng(3)
    n = 30_000
    data = {"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.5, 1.0, rng.normal(size=n)), "d": np.exp(rng.normal(size=n) * 20), "one": np.full(n, 7.0)}
    df = spark.createDataFrame(list(map(tuple, np.stack(list(data.values()), 1).tolist())), ", ".join(f"{k} double" for k in data)).repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.77777, 0.99995, 1.0]
    found = ordered.selected(df, {k: k for k in data}, at)
    for k, x in data.items():
        assert found[k] == pytest.approx(np.quantile(x, at).tolist(), rel=1e-12), k
    if most == 20:
        monkeypatch.setattr(ordered, "RANKS", 50)  # brackets that are wide, and narrowed again and again
        assert ordered.selected(df, {"a": "a", "d": "d"}, [0.3, 0.9]) == {k: pytest.approx(np.quantile(data[k], [0.3, 0.9]).tolist(), rel=1e-12) for k in "ad"}


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, "x", None), (None, "y", None), (float("nan"), None, None), (float("-inf"), "x", None), (3.0, None, None)], "v double, k string, z double")
    v = ordered.selected(df, {"v": "v", "z": "z"}, [0.0, 1 / 3, 2 / 3, 1.0])
    assert v["v"][:3] == [float("-inf"), 1.0, 3.0] and np.isnan(v["v"][3]) and v["z"] == [None] * 4
    rows = {r.k: r.q0 for r in ordered.quantiles_by(df.where("v = v and v > 0 and not isnan(v)"), "k", "v", [0.5]).collect()}
    assert rows == {"x": 1.0, None: 3.0}
    many = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("v"))
    few = many.where("k < 5")
    want = lambda k: float(np.quantile(np.arange(k, 400, 40), 0.3))
    assert {r.k: r.q0 for r in ordered.quantiles_by(many, "k", "v", [0.3]).collect()} == {k: pytest.approx(want(k)) for k in range(40)}
    assert {r.k: r.q0 for r in ordered.quantiles_by(few, "k", "v", [0.3]).collect()} == {k: pytest.approx(want(k)) for k in range(5)}
    assert ordered.exact_quantiles(df.where("false"), {"v": "v"}, [0.5]).count() == 0


def test_recursive_lineage_ends_in_cycles(spark):
    """On cyclic edges of one time both ways of tracing give the same, at any depth."""
    t0 = dt.datetime(2025, 1, 1)
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 2), (1, 5), (None, 1), (5, None), (7, 8)]
    edges = spark.createDataFrame([(a, b, t0) for a, b in pairs], "parent long, child long, event_ts timestamp")
    seeds = spark.createDataFrame([(1, 1, t0), (7, 7, t0), (4, 4, t0), (9, 9, t0)], "root long, node long, since timestamp")
    for depth in (1, 2, 10):
        rows = lambda df: sorted((r.root, r.node, r.depth, r.since) for r in df.collect())
        assert rows(correlate.traced_recursively(seeds, edges, depth)) == rows(correlate.traced(seeds, edges, depth))
    assert correlate.traced_recursively(seeds.where("false"), edges).count() == 0


def test_recursive_lineage_of_more_rows_than_sparks_limit(spark):
    """Spark stops a recursion at a number of rows, here 50; a lineage is whole beyond it, and the session keeps its limit."""
    t0 = dt.datetime(2025, 1, 1)
    edges = spark.range(100).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"), F.lit(t0).alias("event_ts"))
    seeds = spark.range(100).select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(t0).alias("since"))
    with session.setting(spark, "spark.sql.cteRecursionRowLimit", "50"):
        found = sorted((r.root, r.node, r.depth) for r in correlate.traced_recursively(seeds, edges, 3).collect())
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "50"
    assert found == [(i, i + d, d) for i in range(100) for d in range(4) if i + d <= 100]


def test_tiles_fall_back_to_position(spark):
    """A tile with a label of one row, and one with more labels than rows to test: their first rows are train."""
    rows = [(i, "a" if i != 3 else "rare") for i in range(10)] + [(10 + i, f"l{i // 2}") for i in range(10)] + [(20 + i, "ab"[i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, y string")
    found = {r.k: r.split for r in split.by_tiles(df, ["k"], "k", "y", tiles=3).collect()}
    assert [found[i] == "train" for i in range(20)] == ([True] * 7 + [False] * 3) * 2
    third = [found[20 + i] for i in range(10)]
    assert third.count("train") == 6 and third[0::2].count("train") == third[1::2].count("train") == 3


def test_merged_sketches_stay_inside_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), F.lit("c").alias("column"), F.when(F.col("id") % 10 > 0, F.col("id") % 20_000).alias("value"))
    kept = profile.distinct_sketches(rows, ["day"], "column", "value").checkpoint()
    for days in (kept, kept.where("day < 2"), kept.where("day = 5")):
        r = profile.distinct_over(days, "column").first()
        part = rows.join(days.select("day"), "day", "left_semi")
        exact = part.select("value").distinct().where("value is not null").count()
        assert abs(r.n_distinct - exact) <= 0.03 * exact and r.n == part.count() and r.filled == part.where("value is not null").count()
    assert profile.distinct_over(kept.where("false"), "column").count() == 0
