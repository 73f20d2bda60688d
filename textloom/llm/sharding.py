"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Executors run Spark built-ins only; the driver draws a matrix of bounded size.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, written

#: Cells of the communication matrix on the driver, at most.
MAX_CELLS = 1 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, sample: int) -> int:
    """Exact draw: how many of `sample` items taken without replacement are among the `good`.

    Small draws are simulated; others use ratio-of-uniforms rejection (Stadlober 1990), whose cost does not
    depend on the counts.
    """
    total = good + bad
    if not sample or not good:
        return 0
    if not bad:
        return sample
    if sample == total:
        return good
    if sample <= 16:
        found, g = 0, good
        for i in range(sample):
            if rng.random() * (total - i) < g:
                found, g = found + 1, g - 1
        return found
    lo, hi, m = min(good, bad), max(good, bad), min(sample, total - sample)
    p = lo / total
    centre = m * p + 0.5
    sd = math.sqrt((total - m) * sample * p * (1 - p) / (total - 1) + 0.5)
    width = 1.7155277699214135 * sd + 0.8989161620588988
    mode = (m + 1) * (lo + 1) // (total + 2)

    def weight(x: int) -> float:
        return math.lgamma(x + 1) + math.lgamma(lo - x + 1) + math.lgamma(m - x + 1) + math.lgamma(hi - m + x + 1)

    top, limit = weight(mode), min(min(m, lo) + 1, math.floor(centre + 16 * sd))
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        w = centre + width * (v - 0.5) / u
        if w < 0 or w >= limit:
            continue
        x = math.floor(w)
        if 2 * math.log(u) <= top - weight(x):
            break
    if good > bad:
        x = m - x
    return good - x if m < sample else x


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts that a uniform random permutation sends from each partition to each column; sums are exact."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        line, rest, want = [], sum(left), n
        for c in left:
            x = hypergeometric(rng, c, rest - c, want) if want else 0
            line.append(x)
            rest, want = rest - c, want - x
        left = [c - x for c, x in zip(left, line)]
        out.append(line)
    return out


def shard(df: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Adds `shard` (0..shards-1) and `slot` (gapless from 0 in each shard) to every row of df, uniformly at random.

    Shard sizes differ by one row at most, whatever keys, texts or copies the rows hold: a row's partition comes
    from its place in a written copy of df, never from its values, so no value can make one partition large.
    That copy also makes the draw repeatable when a task runs again; the same seed gives the same layout for the same
    rows in the same partitions and the same number of shuffle partitions. Empty input gives no rows; null values
    and repeated rows are rows like others. Columns named shard or slot are replaced.

    Each shard is split into equal sub-shards with fixed slot ranges, so the second permutation is sorted in
    many small windows and needs no further counting.
    """
    spark = df.sparkSession
    pinned = written(df.drop("shard", "slot"))
    file = F.concat(*[F.lpad(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-.*-c(\d+)", i), 10, "0") for i in (1, 2)])  # without the random name of the run
    rows = pinned.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_place", F.xxhash64(F.lit(seed), "_file", "_row"))

    width = parallelism(spark)
    subs = max(1, math.ceil(4 * width / shards))
    partitions = max(1, min(4 * width, MAX_CELLS // (shards * subs)))
    rows = rows.withColumn("_part", F.pmod("_place", F.lit(partitions)).cast("int"))
    counts = dict(rows.groupBy("_part").count().collect())  # at most `partitions` rows
    total = sum(counts.values())

    sizes, starts = [], []
    for s in range(shards):
        n = total // shards + (s < total % shards)
        cut = [n * i // subs for i in range(subs + 1)]
        sizes += [b - a for a, b in zip(cut, cut[1:])]
        starts += cut[:-1]
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    ends = []
    for p, line in zip(parts, matrix):
        at, cum = 0, []
        for x in line:
            at += x
            cum.append(at)
        ends.append((p, cum))
    plan = spark.createDataFrame(ends, "_part int, _ends array<long>")  # MAX_CELLS numbers at most
    slots = F.array(*[F.lit(x).cast("long") for x in starts]) if len(starts) <= 256 else F.from_json(F.lit(str(starts)), "array<bigint>")

    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_place"), "_file", "_row")
    again = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 2), "_place"), "_file", "_row")
    ranked = rows.withColumn("_rank", F.row_number().over(local))
    sent = ranked.join(F.broadcast(plan), "_part").withColumn("_cell", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    return sent.select(
        *[F.col(c) for c in pinned.columns],
        F.floor(F.col("_cell") / subs).cast("int").alias("shard"),
        (F.get(slots, F.col("_cell")) + F.row_number().over(again) - 1).cast("long").alias("slot"),
    )
