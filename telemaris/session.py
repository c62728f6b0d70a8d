"""Session defaults and table access shared by every operator."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "telemaris", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; conf wins over them."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Zone-less timestamps become instants in UTC, as epoch functions need them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType == T.TimestampNTZType()]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


#: The folders made inside scratch(), or None outside.
FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder, as a full URI, below the one that spark.checkpoint.dir names.

    Only where that is unset and Spark is local (tests), a temporary folder is set in its place.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="telemaris-"))
        base = sc.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(base, f"{name}-{uuid.uuid4().hex}"))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if (made := FOLDERS.get()) is not None:
        made.append(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that shared_dir gave; nothing happens if it is gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at the end: results must be written elsewhere, or collected, by then."""
    token = FOLDERS.set([])
    try:
        yield
    finally:
        for folder in FOLDERS.get():
            remove(spark, folder)
        FOLDERS.reset(token)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for what runs inside; the one before holds again at the end."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs no earlier work."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that last as long as the application, by what is in them.
KEPT: dict[tuple[str, ...], str] = {}


def kept(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """A folder that `write` filled, once in an application for each name and source; deleted when the application ends."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in KEPT:
        token = FOLDERS.set(None)  # scratch() around this call does not own the folder
        try:
            folder = shared_dir(spark, name)
        finally:
            FOLDERS.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        try:
            write(folder)
        except BaseException:
            remove(spark, folder)  # the next query writes one of its own
            raise
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        KEPT[key] = folder
    return KEPT[key]
