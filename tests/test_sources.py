"""Scans, parsers and rewrite rules on small made-up files."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from telemaris import session
from telemaris.functions import classify, clean
from telemaris.plans import ingest, registry  # noqa: F401  importing ingest registers its queries
from telemaris.sources import files, flows, host_events


def xml(event_id, computer, **data):
    head = f"<EventID>{event_id}</EventID>" if event_id is not None else ""
    fields = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data.items())
    return f'<Event xmlns="http://schemas.example/event"><System>{head}{f"<Computer>{computer}</Computer>" if computer else ""}</System><EventData>{fields}</EventData></Event>'


def test_json_lines_keep_bad_ones_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2, "b": "x"}\n{"a": \n')
    good, bad = files.json_lines(spark, str(tmp_path / "a.jsonl"), "a long, b string")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert bad.count() == 2


def test_host_events(spark):
    rows = [
        (xml(1, "h1", ProcessGuid="{A-1}", ProcessId=" 12 ", Image="c:\\x.exe", CommandLine="é x"),),
        (xml(8, "h1", SourceProcessGuid="{B}", TargetProcessGuid="{}", SourceProcessId="12.0"),),
        (xml(4, "h2", Image="y"),),
        (xml(None, "h3"),),
        (xml(1, None),),
        ("<broken",),
    ]
    events, rejects = host_events.parsed(spark.createDataFrame(rows, "original string"))
    assert rejects.count() == 3
    out = {r.EventID: r for r in host_events.typed(events).collect()}
    assert out[1].ProcessGuid == "A-1" and out[1].ProcessId == 12 and out[1].CommandLine == "x"
    assert out[8].SourceProcessGUID == "B" and out[8].TargetProcessGUID is None and out[8].SourceProcessId == 12
    assert out[4].Computer == "h2" and out[4].Image is None  # an id without a field list
    missing = {(r.EventID, r.field): (r.missing, r.total) for r in host_events.missing_fields(events).collect()}
    assert missing[1, "User"] == (1, 1) and missing[1, "Image"] == (0, 1) and missing[8, "SourceProcessGUID"] == (0, 1)


def test_flow_documents(spark):
    docs = [
        {"@timestamp": "2025-01-29T04:24:54.863Z", "destination": {"ip": "8.8.8.8", "port": "443.0"}, "event": {"type": ["connection", "end"]}, "host": {"ip": ["10.0.0.1"], "mac": []}},
        {"@timestamp": "nonsense", "source": {"bytes": 5, "process": {"args": ["a", "b"]}}},
    ]
    raw = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").select(F.from_json("value", flows.SCHEMA).alias("d")).select("d.*")
    a, b = flows.flat(raw).collect()
    assert a.destination_port == 443 and a.event_type == "connection" and a.host_mac is None and a.host_ip == ["10.0.0.1"] and a.process_args == []
    assert b.timestamp is None and b.source_process_args == ["a", "b"]
    assert len(a) == 34


@pytest.mark.parametrize("name", ["flow_table", "external_destinations", "process_network_use", "duration_classes"])
def test_flow_queries_take_little_disk(spark, sf, tmp_path, name):
    """The lines that a query writes and reads back are compressed: less than three times their table, as text 25 times."""
    (tmp_path / "lineitem.parquet").symlink_to(f"{sf}/lineitem.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count()
    folder = session.KEPT[spark.sparkContext.applicationId, "flows", str(tmp_path)].removeprefix("file:")
    assert 0 < sum(p.stat().st_size for p in Path(folder).iterdir()) < 3 * Path(sf, "lineitem.parquet").stat().st_size


def test_compressed_lines_are_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_LINES", 40)
    files.write_lines(spark.range(100, numPartitions=1).select(F.format_string('{"a": %d}', "id").alias("value")), str(tmp_path / "lines"))
    assert sorted(len(gzip.open(p).read().split()) // 2 for p in (tmp_path / "lines").glob("*.gz")) == [20, 40, 40]
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "lines"), "a long")[0].collect()) == list(range(100))


def test_failed_exports_leave_nothing(spark):
    made = []

    def write(folder):
        made.append(folder.removeprefix("file:"))
        spark.range(3).write.parquet(folder)
        raise OSError("no space")

    with pytest.raises(OSError):
        session.kept(spark, "failing", "x", write)
    assert not Path(made[0]).exists()


def test_report_rules(spark, tmp_path):
    report = [{"delegated_timestamp": "2025-01-29T04:24:54Z", "command": c, "attack_metadata": {"tactic": "t"}} for c in ("whoami", 'run cmd="dir x"', "exec: a", "plain")]
    (tmp_path / "r.json").write_text(json.dumps(report))
    entries = flows.report_entries(files.json_array(spark, str(tmp_path / "r.json"), flows.REPORT).withColumn("i", F.monotonically_increasing_id()), "i")
    rules = spark.createDataFrame([(1, 0, "capture", 'cmd="([^"]*)"', "shell($1)"), (1, 1, "keep", None, None), (2, 0, "strip", "^exec: ", None), (3, 0, "capture", "(zz)", "$1")], "entry long, position int, kind string, pattern string, template string")
    out = flows.rewritten(entries, rules).orderBy("new_entry").collect()
    assert [r.new_command for r in out] == ["whoami", "shell(dir x)", 'run cmd="dir x"', "a", "plain"]
    assert [r.new_entry for r in out] == [0, 1, 2, 3, 4] and out[0].technique_name == ""
    assert out[0].delegated_timestamp == "2025-01-29 04:24:54.000000"


def test_csv_tree(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "dataset-3.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "s" / "dataset-30.csv").write_text("b,c\nz,9\n")
    rows = files.csv_tree(spark, str(tmp_path), ["a", "b", "c"]).withColumn("campaign", classify.file_campaign("file_name")).collect()
    assert sorted((r.a or "", r.b, r.c or "", r.campaign) for r in rows) == [("", "z", "9", "APT2"), ("1", "x", "", "APT1"), ("2", "y", "", "APT1")]


def test_bad_files_of_a_tree_are_reported_and_skipped(spark, tmp_path):
    """Bytes that are no text, nothing at all, a blank first line and a name of two colliding headers; a file that nobody may read."""
    (tmp_path / "s ü").mkdir()
    (tmp_path / "s ü" / "good one.csv").write_text('a,"b, c",a\n1,"x, y",3\n\n2\n')
    (tmp_path / "other.csv").write_text("b, c\nq,r\n")
    (tmp_path / "zip.csv").write_bytes(b"PK\x03\x04\0\0binary")
    (tmp_path / "latin.csv").write_bytes(b"caf\xe9,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\na,b\n1,2\n")
    rows, outcomes = files.csv_tree_outcomes(spark, str(tmp_path), ["a", "b, c", "nowhere"])
    assert sorted((r.a or "", r["b, c"] or "", r.nowhere) for r in rows.collect()) == [("", "", None), ("1", "x, y", None), ("2", "", None)]
    found = {r.file.rsplit("/")[-1]: (r.outcome, r.reason) for r in outcomes.collect()}
    want = {"good%20one.csv": ("read", None), "other.csv": ("read", None), "zip.csv": ("rejected", "no text"), "latin.csv": ("rejected", "no text"), "empty.csv": ("rejected", "empty"), "blank.csv": ("rejected", "no header")}
    assert found == want
    assert files.first_line(str(tmp_path / "gone.csv"))[1].startswith("not readable")


def test_parsers_run_once_for_each_row(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"event": {"original": xml(1, "h", Image="x")}}) + "\n")
    rows, _ = files.json_lines(spark, str(tmp_path / "a.jsonl"), "event struct<original:string>")
    events, _ = host_events.parsed(rows.select(F.col("event.original").alias("original")))
    plan = host_events.typed(events)._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("from_xml(") + plan.count("xmltostructs(") == 1 and plan.count("from_json(") + plan.count("jsontostructs(") == 1
    twice = spark.createDataFrame([('<Event><System><EventID>1</EventID><Computer>c</Computer></System><EventData><Data Name="Image">a</Data><Data Name="Image">b</Data></EventData></Event>',)], "original string")
    assert host_events.typed(host_events.parsed(twice)[0]).first().Image == "b"


def test_listing_and_manifest(spark, tmp_path):
    (tmp_path / "sysmon-a.txt").write_text("abc")
    (tmp_path / "flow-b.txt").write_text("a")
    found = files.listing(spark, str(tmp_path), ["sysmon", "flow"])
    assert found.count() == 2 and files.smallest(found).first().path.endswith("flow-b.txt")
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    assert [r.run for r in files.to_do(runs, runs.where("run = 'a'"), "run").collect()] == ["b"]


def test_versioned_output_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("m", "d", "v1", 1.0)], "model string, dataset string, version string, x double")
    files.write_versioned(df, str(tmp_path / "o"))
    files.write_versioned(df.withColumn("version", F.lit("v2")), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    files.write_csv(df.withColumn("l", F.array(F.lit(1))), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().l == "[1]"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"model": "a", "performance": {"roc_auc": 0.9}}')
    (tmp_path / "j" / "b.json").write_text('{"model": "b", "roc_auc": 0.8}')
    assert {r.model: r.roc_auc for r in files.metrics_files(spark, str(tmp_path / "j"), ["roc_auc"]).collect()} == {"a": 0.9, "b": 0.8}
    curves = spark.createDataFrame([("m", "d", [0.0, 1.0], None, [0.1, 0.9])], "model string, dataset string, fpr array<double>, x array<double>, tpr array<double>")
    assert [(r.seq, r.x, r.y) for r in files.curve_points(curves, ["x", "fpr"], ["tpr"]).collect()] == [(0, 0.0, 0.1), (1, 1.0, 0.9)]


def test_cleaning(spark):
    df = spark.createDataFrame([(" 12 ", "{a}", " x "), ("12.9", "{}", ""), ("-3.7", None, None), ("inf", "b", "y"), ("x", "", "z"), (None, None, None)], "n string, g string, t string")
    out = df.select(clean.safe_int("n").alias("n"), clean.clean_guid("g").alias("g"), clean.clean_text("t").alias("t")).collect()
    assert [r.n for r in out] == [12, 12, -3, None, None, None]
    assert [r.g for r in out] == ["a", None, None, "b", None, None]
    assert [r.t for r in out] == ["x", None, None, "y", "z", None]
    times = spark.createDataFrame([("Jan 29, 2025 @ 04:24:54.863 (UTC)",), ("Jan 29, 2025 @ 04:24:54.863123 (UTC)",), ("no",)], "t string").select(F.unix_micros(clean.human_time("t")).alias("u")).collect()
    assert times[0].u == 1738124694863000 and times[1].u == 1738124694863123 and times[2].u is None
    assert spark.range(1).select(clean.range_list(F.lit("0-2, 7")).alias("r")).first().r == [0, 1, 2, 7]
    labels = spark.createDataFrame([(" Normal ",), ("x",), (None,)], "l string").select(clean.binary_label("l", "normal").alias("y")).collect()
    assert [r.y for r in labels] == [0, 1, 1]


def test_classes(spark):
    ips = spark.createDataFrame([("10.1.1.1",), ("172.40.0.1",), ("239.1.1.1",), ("8.8.8.8",), (None,)], "ip string")
    out = ips.select(classify.ip_class("ip").alias("c"), classify.is_private_ip("ip").alias("p"), classify.is_external_ip("ip").alias("e")).collect()
    assert [r.c for r in out] == ["Internal", "Internal", "Multicast", "External", "Unknown"]
    assert [r.p for r in out] == [True, False, False, False, False] and [r.e for r in out] == [False, False, True, True, False]
    paths = spark.createDataFrame([("C:\\Windows\\a b.EXE", "C:\\x\\Cmd.exe /c dir"), ("noslash", "  ls -enc")], "p string, c string")
    a, b = paths.select(classify.directory("p").alias("d"), classify.extension("p").alias("x"), classify.base_command("c").alias("c"), *(v.alias(k) for k, v in classify.file_flags("p").items()), *(v.alias(k) for k, v in classify.flags("c", classify.COMMAND_FLAGS).items())).collect()
    assert a.d == "C:\\Windows" and a.x == "exe" and a.c == "cmd.exe" and a.executable and a.has_space and not a.encoded
    assert b.d == "noslash" and b.x is None and b.c == "ls" and b.encoded
