"""Query op10: benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contaminated


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, match_end."""
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, bench).select("doc_id", "item_id", "distance", "match_end")


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {}
