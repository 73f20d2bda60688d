"""URL filters: a blocked Bloom filter of listed URL prefixes in front of an exact hash join.

All expressions are Spark built-ins; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: One block of the filter is 8 words of 32 bits; a key sets one bit in each word of its block.
WORDS = 8
#: Upper bound of the filter: 2**17 blocks, 4 MiB. A longer list gets a fuller filter, never wrong results.
MAX_BLOCKS = 1 << 17
#: The list is broadcast up to this many rules; beyond it the exact join is shuffled.
MAX_BROADCAST_RULES = 100_000
#: Different path lengths of rules that are named one by one.
MAX_LENGTHS = 4096
#: Pairs that hold one of so many rows at least are broadcast.
MOST = 1000


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased in A-Z only; null or no '://' gives two empty strings."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = _lower(host)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(host: Column, path: Column) -> Column:
    """Canonical text of a listed prefix; a host holds no slash, so the pair can be read back."""
    return F.concat(host, F.lit("\n"), path)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).cast("int")


def _bits(h: Column) -> list[Column]:
    """The bit that a key sets in each word: five bits of a multiplicative mix of the low half."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits times 32 stay within a long
    salts = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
    mixed = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in salts]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), m) for m in mixed]


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of column `key`, as a table of its blocks that hold any key: b, w0 to w7."""
    h = F.xxhash64("key")
    rows = keys.select(_block(h, blocks).alias("b"), *[x.alias(f"w{i}") for i, x in enumerate(_bits(h))])
    return rows.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of df.

    rules: host, path, verdict. A rule fits its host and all subdomains where the path starts with the rule's
    path; the longest (host, then path, then 'block' before 'allow') wins; a row without a rule gets `default`.
    Hosts of rules are lower-cased in A-Z only, like those of urls.

    Distinct (host, path) pairs are judged once. Each pair offers every host suffix with every prefix of a listed
    length, one row each, to the filter's block of that key; the exact join on the listed prefix removes the false
    positives. Pairs that a thousandth of all rows or more hold (at most a thousand pairs) are broadcast to their rows.
    Of the others none has so many rows that its join key could make one task large; rows that need no judgement get
    join keys of their own.
    Null or malformed URLs have empty host and path and match nothing; an empty rule list gives `default`
    everywhere. Columns of df named like an output column are replaced.
    """
    host, path = parse_url(F.col(url))
    df = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    listed = (
        rules.select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null and verdict is not null")
        .groupBy(_key(F.col("host"), F.col("path")).alias("key"))
        .agg(F.max("verdict").alias("rule_verdict"), F.max(F.concat("host", "path")).alias("rule"), F.max(F.length("host")).alias("host_len"), F.max(F.length("path")).alias("path_len"))
    )
    listed = written(listed)
    n = listed.count()
    if not n:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = [r[0] for r in listed.select("path_len").distinct().orderBy("path_len").limit(MAX_LENGTHS + 1).collect()]
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * WORDS * 32 < 20 * n:
        blocks *= 2
    bloom = build_filter(listed.select("key"), blocks)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # more lengths than MAX_LENGTHS: every prefix up to the longest rule is looked up
    some = F.array(*[F.lit(x) for x in lengths]) if len(lengths) <= MAX_LENGTHS else F.sequence(F.lit(0), F.lit(listed.agg(F.max("path_len")).first()[0]))
    heads = F.filter(some, lambda x: x <= F.length("path"))

    pairs = written(df.select("host", "path").where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    keys = pairs.select("host", "path", "n", F.explode(suffixes).alias("s")).select("host", "path", "n", "s", F.explode(heads).alias("x"))
    keys = keys.select("host", "path", "n", _key(F.col("s"), F.col("path").substr(F.lit(1), F.col("x"))).alias("key"))
    h = F.xxhash64("key")
    probe = keys.withColumns({"b": _block(h, blocks), **{f"k{i}": x for i, x in enumerate(_bits(h))}})
    held = probe.join(F.broadcast(bloom), "b")  # at most MAX_BLOCKS rows
    for i in range(WORDS):
        held = held.where(F.col(f"w{i}").bitwiseAND(F.col(f"k{i}")) != 0)
    exact = F.broadcast(listed) if n <= MAX_BROADCAST_RULES else listed
    best = (
        held.select("host", "path", "n", "key").join(exact, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("host_len", "path_len", "rule_verdict", "rule")).alias("best"), F.max("n").alias("n"))
    )
    best = written(best.select("host", "path", "n", "best.rule", "best.rule_verdict"))
    common = pairs.where(F.col("n") * MOST >= total).select("host", "path").join(best, ["host", "path"], "left")  # at most MOST rows
    common = common.select("host", "path", F.lit(True).alias("_done"), F.col("rule").alias("_rule"), F.col("rule_verdict").alias("_verdict"))
    first = df.join(F.broadcast(common), ["host", "path"], "left")
    own = F.when(F.col("_done") | (F.col("host") == ""), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
    rest = best.where(F.col("n") * MOST < total).select("host", "path", F.lit(0).cast("long").alias("_own"), "rule", "rule_verdict")
    out = first.withColumn("_own", own).join(rest, ["host", "path", "_own"], "left")
    found = {"rule": F.coalesce("rule", "_rule"), "verdict": F.coalesce("rule_verdict", "_verdict", F.lit(default))}
    return out.withColumns(found).select(*df.columns, "rule", "verdict")
