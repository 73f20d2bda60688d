"""Shared plumbing of the corpus operators: session set-up, broadcasts, reading."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.storage import passing, shared_dir, written

__all__ = ["Sent", "numbered", "parallelism", "passing", "shared_dir", "table", "text_bytes", "tune", "written"]


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds: whole texts may be long, so few rows travel together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Sent:
    """A broadcast of any object, its classes included, so that executors need not import this package."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        """The object; a worker that runs several tasks unpacks it once."""
        if not hasattr(self.data, "_unpacked"):
            self.data._unpacked = cloudpickle.loads(self.data.value)
        return self.data._unpacked


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> "F.Column":
    """UTF-8 length of a text column; null counts 0."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number, written once: however df is computed, every later read sees the same number for a row."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))
