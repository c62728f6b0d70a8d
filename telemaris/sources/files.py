"""Files in and out: scans that keep bad rows apart, CSV groups by header, manifests of work done."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from telemaris.functions.clean import once
from telemaris.session import written

BAD = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a file of one JSON object per line. Blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(BAD, T.StringType())])
    parsed = once(lines, F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}), "row")
    good = F.col(f"row.{BAD}").isNull() & F.col("row").isNotNull()
    names = T.StructType.fromDDL(schema).fieldNames()
    return parsed.where(good).select(*(F.col("row")[n].alias(n) for n in names)), parsed.where(~good).select("value")


#: A compressed file is read by one task, so none has more lines.
FILE_LINES = 1_000_000


def write_lines(df: DataFrame, path: str) -> None:
    """One text column as lines of gzip files, FILE_LINES at most in each: JSON lines repeat their names, and take a tenth of the disk so."""
    df.write.option("maxRecordsPerFile", FILE_LINES).text(path, compression="gzip")


def between(df: DataFrame, ts: str, start: str | Column, end: str | Column) -> DataFrame:
    """Rows of a time range, both ends included; the predicate reaches the scan."""
    return df.where(F.col(ts).between(start, end))


def listing(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """(path, length, modificationTime) of the files whose names hold one of the keywords. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.lit(False)
    for k in keywords:
        wanted = wanted | name.contains(k.lower())
    return files.where(wanted).select("path", "length", "modificationTime")


#: So much of a file is read to find its first line.
HEAD_BYTES = 1 << 20


def first_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, head, reason) of each file below a folder: its first line, or why there is none. No more than HEAD_BYTES of a file is read.

    Scans pass over files of no bytes, so those come from the names that the driver has listed for the scan anyway. Tasks open the files themselves; where the store is none that Arrow knows, the files' first blocks are scanned by Spark.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    names = spark.createDataFrame([(f,) for f in listed.inputFiles()], "file string")
    listed = listed.select("path", F.col("_metadata.file_path").alias("file"))
    one_form = lambda df: df.withColumn("same", F.regexp_replace("file", "^(\\w+):/+", "$1:/"))  # noqa: E731  both are encoded, but the slashes differ
    empty = one_form(names).join(one_form(listed).select("same"), "same", "left_anti").select("file", F.lit(None).cast("string").alias("head"), F.lit("empty").alias("reason"))
    qualified = spark._jvm.org.apache.hadoop.fs.Path(path)
    qualified = qualified.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(qualified).toString()
    try:
        fs.FileSystem.from_uri(uri(qualified))
    except (pa.ArrowInvalid, OSError):
        scan = spark.read.option("ignoreCorruptFiles", "true").text(path, pathGlobFilter=pattern, recursiveFileLookup=True)
        heads = scan.select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at")).where("at = 0").groupBy("file").agg(F.first("value").alias("head"))
        found = listed.select("file").join(heads, "file", "left")
        return found.withColumn("reason", F.when(F.coalesce(F.trim("head"), F.lit("")) == "", "no header").when(F.contains("head", F.lit("\0")), "no text")).unionByName(empty)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *first_line(p)) for p, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("file", "head", "reason"))})

    return listed.mapInArrow(read, "file string, head string, reason string").unionByName(empty)


def uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def first_line(path: str) -> tuple[str | None, str | None]:
    """(first line, reason why there is none) of a file."""
    try:
        files, at = fs.FileSystem.from_uri(uri(quote(path, safe=":/")))
        with files.open_input_file(at) as f:
            raw = f.read(HEAD_BYTES)
    except OSError as e:
        return None, f"not readable: {type(e).__name__}"
    line = raw.split(b"\n")[0].rstrip(b"\r")
    if b"\0" in raw:
        return None, "no text"
    try:
        head = line.decode()
    except UnicodeDecodeError:
        return None, "no text"
    return (head, None) if head.strip() else (None, "no header")


def _picked(row: Column, names: list[str], columns: list[str]) -> Column:
    """The wanted columns of a parsed row, in an array of one; null where the row has no such name."""
    return F.transform(F.array(row), lambda x: F.struct(*((x[c] if c in names else F.lit(None).cast("string")).alias(c) for c in columns)))


def csv_tree_outcomes(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes): all CSV files below a folder as one table of the wanted columns, and (file, outcome, reason) for each file.

    Columns that a file lacks are null; rows have their `file_name`. A file without a header line, of bytes that are no text, or
    that cannot be opened is `rejected` with the reason, and all others are read. Lines are parsed in one scan, each by its file's
    header; lines equal to the header are no rows. Of a name that stands twice in a header the first column counts. Only the
    different headers, not the files' names, reach the driver.
    """
    files = written(first_lines(spark, path, pattern), "outcomes")
    parsers = [F.lit(None).cast(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in columns])))]
    for r in files.where("reason IS NULL").select("head").distinct().collect():  # a row for each different header
        names: list[str] = []
        for name in next(csv.reader([r["head"]], escapechar="\\"), []):
            names.append(name.strip() if name.strip() not in names else f"{name.strip()}#{len(names)}")
        row = F.from_csv("value", ",".join(f"`{n.replace('`', '``')}` string" for n in names), {"mode": "PERMISSIVE"})
        parsers.insert(0, F.when(F.col("head") == r["head"], _picked(row, names, columns)))
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path, pathGlobFilter=pattern, recursiveFileLookup=True)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name")).where(F.trim("value") != "")
    lines = lines.join(files.where("reason IS NULL").select("file", "head"), "file").where(F.col("value") != F.col("head"))
    rows = lines.select("file_name", F.explode(F.coalesce(*parsers)).alias("row")).select(*(F.col("row")[c].alias(c) for c in columns), "file_name")
    return rows, files.select("file", F.when(F.col("reason").isNull(), "read").otherwise("rejected").alias("outcome"), "reason")


def csv_tree(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.csv") -> DataFrame:
    """The rows of csv_tree_outcomes()."""
    return csv_tree_outcomes(spark, path, columns, pattern)[0]


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays, maps and structs are written as JSON."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)


def write_versioned(df: DataFrame, path: str) -> None:
    """Partitions model/dataset/version; only those that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "dataset", "version").parquet(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def to_do(runs: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """The runs without an output."""
    return runs.join(done, key, "left_anti")


def smallest(files: DataFrame) -> DataFrame:
    """The smallest file, as a trial input."""
    return files.orderBy("length", "path").limit(1)


def metrics_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Metric JSON files whose numbers stand under `performance` or at the top."""
    kind = ",".join(f"`{n}` double" for n in names)
    rows = spark.read.schema(f"model string, dataset string, version string, {kind}, performance struct<{kind}>").json(path, multiLine=True)
    return rows.select("model", "dataset", "version", *(F.coalesce(F.col("performance")[n], F.col(n)).alias(n) for n in names))


def curve_points(df: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """(model, dataset, seq, x, y): array columns under the first name that a row has, one row for each point."""
    pairs = F.arrays_zip(F.coalesce(*map(F.col, x)).alias("x"), F.coalesce(*map(F.col, y)).alias("y"))
    return df.select("model", "dataset", F.posexplode(pairs).alias("seq", "p")).select("model", "dataset", "seq", F.col("p")["x"].alias("x"), F.col("p")["y"].alias("y"))


def write_report(row: DataFrame, path: str) -> None:
    """A one-row summary (counts, flags, columns) as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Encoded rows or sequences, a partition for each split; scans of one split read nothing else."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def log_runs(entries: DataFrame, path: str) -> DataFrame:
    """Append (run, kind, status, seconds) rows to the log; return how many runs have each status at last, and their seconds."""
    entries.withColumn("logged", F.current_timestamp()).write.mode("append").parquet(path)
    log = entries.sparkSession.read.parquet(path)
    last = log.groupBy("run", "kind").agg(F.max_by(F.struct("status", "seconds"), "logged").alias("x"))
    return last.groupBy("kind", F.col("x.status").alias("status")).agg(F.count("*").alias("n"), F.sum("x.seconds").alias("seconds"))
