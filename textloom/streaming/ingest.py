"""Books as a stream: files that arrive in a folder are parsed into documents.

Books are independent, so there is no state and no watermark; the checkpoint makes each file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.books import Limits, parse_books

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, folder: str, limits: Limits = Limits(), files_per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return parse_books(files, limits)


def write_documents(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends parsed documents to a Parquet table until all files now there are done."""
    return documents.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
