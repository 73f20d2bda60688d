"""Query op4: languages of all documents, learned from two thirds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import fit, predict


def held(doc_id: "F.Column", of: int, rest: int) -> "F.Column":
    """Whether crc32 of doc_id as text has this remainder; a null doc_id is always held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(True))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held(F.col("doc_id"), 3, 1))
    return predict(docs, model).select("doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_langid": op4_langid}
SQL: dict[str, str] = {}
