"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("_scopes", default=())
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether a join deals both sides out anew unless they are dealt out by all of its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a local session gets a folder of its own; any other master is an error,
    because executors on other machines could not read it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, rows_per_file: int | None = None, stays: bool = False, by_book: bool = False) -> DataFrame:
    """df, computed once, written as Parquet in the shared folder and read back.

    Lineage ends at the table, so a lost executor costs only the tasks it was running. Shuffle files of the plan go as
    soon as it is written, not when the driver happens to collect its garbage. stays: the table outlives the innermost
    scope of passing(). by_book: joins by a book and more leave rows where they are if books lie together already.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom/{uuid.uuid4().hex}"
    scopes = _scopes.get()[:-1] if stays else _scopes.get()
    (scopes[-1] if scopes else _written).append((spark, path))
    out = df.write.option("compression", "zstd")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    wanted = {CLEANUP: "true"} | ({ALL_KEYS: "false"} if by_book else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        out.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Tables written inside are deleted at the end, except those that stay: no plan that is used later may read them."""
    inside: list[tuple[SparkSession, str]] = []
    token = _scopes.set((*_scopes.get(), inside))
    try:
        yield
    finally:
        _scopes.reset(token)
        for spark, path in inside:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the session has ended already
            return
