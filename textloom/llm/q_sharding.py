"""Query op7: documents into 40 shards under the law of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .sharding import shard


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, slot, size and text hash, under the law of equal row counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (text_bytes("text") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
