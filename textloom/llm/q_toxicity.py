"""Query op3: toxicity of all documents, learned from four fifths of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .q_langid import held
from .toxicity import fit, score


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by its nearest labelled examples, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    index = fit(docs, labels, ~held(F.col("doc_id"), 5, 0))
    return score(docs, index).select(
        "doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
