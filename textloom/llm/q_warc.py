"""Query op9: every page into WARC bundles and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import read_bundles, write_bundles


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to bundles and read back."""
    return read_bundles(write_bundles(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


QUERIES = {"op9_warc": op9_warc}
_NIBBLES = "['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']"
SQL = {
    "op9_warc": f"""
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
), b as (
  select page_id, strlen(body) as n, h,
    array_to_string(list_transform(range(1, 41), lambda i: {_NIBBLES}[strpos('0123456789abcdef', substr(h, i, 1))]), '') as bits,
    max(page_id) over (partition by body) as head
  from p
)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * cast(substr(bits, 5 * k + 1, 1) as int) + 8 * cast(substr(bits, 5 * k + 2, 1) as int) + 4 * cast(substr(bits, 5 * k + 3, 1) as int)
      + 2 * cast(substr(bits, 5 * k + 4, 1) as int) + cast(substr(bits, 5 * k + 5, 1) as int), 1)), '') as payload_digest,
  case when page_id = head then 'response' else 'revisit' end as record_type,
  case when page_id = head then null else head end as refers_to
from b
"""
}
