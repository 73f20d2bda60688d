"""Tab-separated records without quoting."""

from __future__ import annotations

import contextlib
import os
import stat
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ExtractionError
from .operators.records import tsv_line, unsafe_for_tsv


def checked(records: DataFrame) -> DataFrame:
    """records (id, type, text), or an error if a field holds a tab, return or line feed."""
    bad = records.where(unsafe_for_tsv(F.col("id"), F.col("type"), F.col("text"))).select("id").head()
    if bad is not None:
        raise ExtractionError(f"record {bad[0]!r} holds a tab, return or line feed")
    return records


def write_tsv_dir(records: DataFrame, path: str) -> None:
    """One folder of text files for each book, in the order of the records; for corpora of any size."""
    lines = checked(records).repartition("book_id").sortWithinPartitions("book_id", "seq")
    lines.select("book_id", tsv_line("id", "type", "text").alias("value")).write.partitionBy("book_id").mode("errorifexists").text(path)


def write_tsv(records: DataFrame, path: str) -> int:
    """The records of one book as one local file, replaced in one step; its mode stays, a new file is private.

    Rows stream through the driver, a partition at a time.
    """
    rows = checked(records).orderBy("seq").select(tsv_line("id", "type", "text").alias("line"))
    mode = stat.S_IMODE(os.stat(path).st_mode) if os.path.exists(path) else 0o600
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".records-")
    n = 0
    try:
        with open(fd, "w", encoding="utf-8", newline="") as f:
            for r in rows.toLocalIterator():
                f.write(r[0] + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, mode)
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temporary)
        raise
    return n
