"""Query op6: all documents into sequences of 2048 ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of documents, in sequences of 2048 ids of the public tokenizer."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
