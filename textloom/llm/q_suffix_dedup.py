"""Query op1: passages of 200 bytes that repeat anywhere in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .suffix_dedup import digests


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that stand anywhere else."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
