"""Query op2: the ten nearest of every hundredth vector among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .neighbours import nearest


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every row of embeddings whose vec_id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


QUERIES = {"op2_neighbours": op2_neighbours}
SQL: dict[str, str] = {}
