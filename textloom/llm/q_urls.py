"""Query op8: the fixed rule list over every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .url_filters import filter_urls

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules on every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = {
    "op8_url_filters": f"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), parts as (
  select page_id,
    translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) as path
  from rest
), rules(h, p, v) as (values {_VALUES})
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h) desc, length(p) desc limit 1) as rule,
  coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h) desc, length(p) desc limit 1), 'allow') as verdict
from parts
"""
}
QUERIES = {"op8_url_filters": op8_url_filters}
