"""All queries of this subpackage and their SQL, collected from the modules q_*."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import textloom.llm as here

QUERIES = {}
SQL = {}
for _m in sorted(x.name for x in pkgutil.iter_modules(here.__path__) if x.name.startswith("q_")):
    _mod = importlib.import_module(f"textloom.llm.{_m}")
    QUERIES |= _mod.QUERIES
    SQL |= _mod.SQL


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
