"""Corpus pipeline: documents through five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import passing, table, written
from textloom.llm.decontaminate import decontaminate
from textloom.llm.packing import pack
from textloom.llm.simhash import keep_one
from textloom.llm.suffix_dedup import without_repeats
from textloom.llm.toxicity import fit, reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; labels come from the table `labels`, whatever their fold."""
    index = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.lit(True))
    return reject(docs, index)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the smallest doc_id."""
    return keep_one(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; n_chars follows the text. Every document stays."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, placed in sequences of 2048 ids."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]
#: The stages are trained models, hashes of whole texts and iterations, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with passing():  # what a stage wrote on its way goes when its result is there
            docs = written(stage(spark, docs, sf_dir), stays=True)
    return docs
