"""SimHash fingerprints and near-duplicate groups, by pivot distance tables.

The Hamming distances of every fingerprint to 36 reference fingerprints are tabled. Pairs come from equal cells of this
table, are discarded by their largest coordinate difference, and survivors are verified.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, passing, tune, written
from .components import components

#: Bit ranges (low bit, width). Fingerprints at distance 2 or less agree in 3 of these 5 blocks at least.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
PATTERNS = 5  # reference fingerprints for each block, which differ from the first one inside that block only
FREE = 10  # further reference fingerprints, drawn freely
WORD = 9  # distances that one long holds, 7 bits each


def _references() -> list[int]:
    """The reference fingerprints, all different: a base, then PATTERNS that differ from it inside one block, for each
    block, then FREE ones."""
    rng = random.Random(2024)
    base = rng.getrandbits(64)
    inside = [base ^ (x << low) for low, width in BLOCKS for x in rng.sample(range(1, 1 << width), PATTERNS)]
    return [base, *inside, *(rng.getrandbits(64) for _ in range(FREE))]


PIVOTS = [x - (1 << 64) if x >> 63 else x for x in _references()]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats counted; no words: 0."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return digest(b" ".join(w), 42)
    counts, n = np.zeros(64, dtype=np.int64), len(w) - words + 1
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + words - 1]
        h = np.array([digest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(words)))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint(t.as_py(), words) for t in b["text"]]
        fps = [x - (1 << 64) if x >> 63 else x for x in fps]
        yield pa.RecordBatch.from_arrays([b["row_no"], b["doc_id"], pa.array(fps, pa.int64())], names=["row_no", "doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(row_no, doc_id, fp) of every row, written to the shared folder; row_no is the row's place in the scan."""
    tune(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(lambda it: _fingerprints(it, words), "row_no long, doc_id long, fp long"))


def pivot_table(fp: Column) -> list[Column]:
    """Hamming distances of a fingerprint to all PIVOTS, WORD of them in each long."""
    distances = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in PIVOTS]
    words = [distances[i : i + WORD] for i in range(0, len(distances), WORD)]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 7 * i) for i, d in enumerate(w)]).alias(f"p{k}") for k, w in enumerate(words)]


WORDS = -(-(1 + len(BLOCKS) * PATTERNS + FREE) // WORD)


def _distance(i: int, side: str = "") -> Column:
    return F.shiftright(F.col(f"{side}p{i // WORD}"), 7 * (i % WORD)).bitwiseAND(F.lit(127))


def _cell(block: int, side: str = "") -> Column:
    """What the table says about one block: distances to its references less the distance to the base.

    Outside the block these references equal the base, so fingerprints that agree in the block have the same cell.
    """
    first = 1 + block * PATTERNS
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_distance(first + j, side) - _distance(0, side) + 16, 5 * j) for j in range(PATTERNS)])


def candidates(fps: DataFrame) -> DataFrame:
    """Pairs (x, y: structs of fp and table) of distinct fingerprints that share the cells of three blocks, each pair once.

    Two fingerprints that differ in two bits or fewer agree in three of the five blocks, hence in these blocks' cells.
    A pair is reported by the first block triple whose cells it shares. Only fingerprints and keys are shuffled; the
    table's rows of two that meet are made again from these.
    """
    table = fps.select("fp", *pivot_table(F.col("fp"))).select("fp", *[_cell(i).alias(f"c{i}") for i in range(len(BLOCKS))])
    triples = list(itertools.combinations(range(len(BLOCKS)), 3))
    keys = F.array(*[F.struct(F.lit(n).alias("t"), F.xxhash64(F.lit(n), *[f"c{i}" for i in t]).alias("key")) for n, t in enumerate(triples)])
    rows = table.select("fp", F.inline(keys))
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))).select("x.t", F.col("x.fp").alias("x"), F.col("y.fp").alias("y"))
    sides = [F.struct(F.col(side).alias("fp"), *pivot_table(F.col(side))).alias(side) for side in "xy"]
    both = met.select("t", F.inline(F.array(F.struct(*sides))))  # a generator, so that later conditions don't repeat the table
    shared = reduce(lambda a, b: a + b, [F.when(_cell(i, "x.") == _cell(i, "y."), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(BLOCKS))])
    first = [next((n for n, t in enumerate(triples) if all(m >> i & 1 for i in t)), -1) for m in range(1 << len(BLOCKS))]
    return both.where(F.element_at(F.array(*map(F.lit, first)), shared + 1) == F.col("t")).select("x", "y")


def survive(bits: int) -> Column:
    """No reference distance of the pair differs by more than `bits`: by the triangle inequality, others are out of reach."""
    return reduce(lambda a, b: a & b, [F.abs(_distance(i, "x.") - _distance(i, "y.")) <= bits for i in range(len(PIVOTS))])


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in `bits` bits or fewer (at most 2).

    Distances to all PIVOTS are tabled once. Pairs are drawn from cells of the table (see candidates), discarded where
    any coordinate differs by more than `bits`, and the survivors' own distance is taken. Cells are equal for pairs in
    reach, so no neighbouring cell is looked at and a fingerprint is dealt to ten buckets, however many there are.
    A fingerprint has at most 2080 neighbours in reach, so links grow in proportion to fingerprints. Buckets are join
    keys: Spark splits large ones between tasks and no task holds a bucket in memory.
    """
    if not 0 <= bits <= 2:
        raise ValueError("cells of block triples find distances of 0 to 2")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits
    return candidates(fps).where(survive(bits)).where(near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(row_no, doc_id, fp, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id among rows reachable over links of at most `bits` differing bits.
    Copies collapse to one fingerprint before any pair is formed. Null text is empty; texts without words share
    fingerprint zero and are linked like any other; repeated rows and doc_ids are kept; null doc_ids are ignored
    in minima. Other columns of docs are not looked at. No rows give no rows.
    """
    rows = fingerprints(docs, words)
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(written(links(distinct, bits)))
    placed = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    final = written(placed.join(ids, "component").select("fp", "component", "component_id"))
    return rows.join(final, "fp").select("row_no", "doc_id", "fp", "component", "component_id")


BANDS, ROWS = 16, 3  # buckets of a text, and min-wise samples that one bucket takes together
PAIRED = 8  # rows up to which a bucket compares all its pairs at once
SIDE_ROWS, SIDE_SHINGLES = 1024, 1 << 20  # what one side of a block of a larger bucket holds, about
BROADCAST_ROWS = 200_000
BITMAPS = 16_384  # bitmaps of 4 KB that are broadcast, 64 MB


def shingle_hashes(text: str | None, words: int):
    """Distinct XXH64 hashes of a text's word shingles, sorted."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), 42)] if w else [], dtype=np.uint64)
    return np.unique(np.array([digest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(words)))], dtype=np.uint64))


def _features(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Hash of the word sequence, fingerprint, number of shingles and bucket keys of each text."""
    import numpy as np
    import xxhash

    multipliers = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in batches:
        out = []
        for text in b["text"].to_pylist():
            both = xxhash.xxh3_128_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))
            h, least = shingle_hashes(text, words), np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
            counts = np.zeros(64, dtype=np.int64)
            for at in range(0, len(h), 1 << 13):
                part = h[at : at + (1 << 13)]
                least = np.minimum(least, (part[:, None] * multipliers).min(axis=0))
                counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            fp = int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])
            keys = [xxhash.xxh3_64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]
            out.append(((both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63), fp, len(h), keys))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [b["row_no"], b["doc_id"], *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["row_no", "doc_id", "d1", "d2", "fp", "size", "bands"]
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingle_hashes(t.as_py(), words).astype("<u8").tobytes() for t in b["text"]]
        yield pa.RecordBatch.from_arrays([b["row_no"], pa.array(found, pa.binary())], names=["id", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets reach the similarity."""
    import numpy as np

    for b in batches:
        keep = []
        for x, y in zip(b["x"], b["y"]):
            x, y = (np.frombuffer(z.as_py(), dtype="<u8") for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _overlaps(left: list, right: list):
    """Numbers of shingles that each set of one list shares with each set of another."""
    import numpy as np

    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (left, right)]
    tokens, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut, cells = int(sizes[0].sum()), len(left) * len(right)
    lt, rt = at[:cut], at[cut:]
    lrow, rrow = (np.repeat(np.arange(len(n)), n) for n in sizes)
    ln, rn = (np.bincount(t, minlength=len(tokens)) for t in (lt, rt))
    order = np.argsort(rt, kind="stable")
    starts = np.concatenate([[0], np.cumsum(rn)])
    out = np.zeros(cells, dtype=np.int64)
    use = np.flatnonzero((rn[lt] > 0) & (ln[lt] * rn[lt] <= 64))  # rare shingles: one by one
    n = rn[lt[use]]
    i = np.arange(int(n.sum())) + np.repeat(starts[lt[use]] - np.cumsum(n) + n, n)
    out += np.bincount(np.repeat(lrow[use], n) * len(right) + rrow[order[i]], minlength=cells)
    out = out.reshape(len(left), len(right))
    often = np.flatnonzero(ln * rn > 64)  # frequent ones: products of 0/1 matrices, exact below 2 ** 24
    for base in range(0, len(often), 2048):
        place = np.full(len(tokens), -1)
        place[often[base : base + 2048]] = np.arange(len(often[base : base + 2048]))
        x, y = np.zeros((len(left), 2048), dtype=np.float32), np.zeros((len(right), 2048), dtype=np.float32)
        for m, row, t in ((x, lrow, place[lt]), (y, rrow, place[rt])):
            m[row[t >= 0], t[t >= 0]] = 1
        out += (x @ y.T).astype(np.int64)
    return out, sizes


def _block_links(rows: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) between the two sides of a block that connect what all its similar pairs connect."""
    import numpy as np

    flags = rows["rest"].to_numpy(zero_copy_only=False).astype(bool)
    ids, comp = rows["id"].to_numpy(), rows["component"].to_numpy()
    sets = [np.frombuffer(x.as_py(), dtype="<u8") for x in rows["shingles"]]
    l, r = np.flatnonzero(flags), np.flatnonzero(~flags)
    found = []
    if len(l) and len(r):
        both, (ln, rn) = _overlaps([sets[i] for i in l], [sets[i] for i in r])
        alike = (both >= similarity * (ln[:, None] + rn[None, :] - both)) & (comp[l][:, None] != comp[r][None, :])
        fresh = [np.ones(len(l), dtype=bool), np.ones(len(r), dtype=bool)]
        for x in np.flatnonzero(alike.any(axis=1)).tolist():
            todo = [(0, x)] if fresh[0][x] else []
            fresh[0][x] = False
            while todo:  # a tree of links: each row is reached once
                side, k = todo.pop()
                near = np.flatnonzero((alike[:, k] if side else alike[k]) & fresh[1 - side])
                fresh[1 - side][near] = False
                for m in near.tolist():
                    found.append((ids[l[m]], ids[r[k]]) if side else (ids[l[k]], ids[r[m]]))
                    todo.append((1 - side, m))
    return pa.table({"a": pa.array([int(x) for x, _ in found], pa.int64()), "b": pa.array([int(y) for _, y in found], pa.int64())})


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row_no, doc_id, component) for every row of docs (doc_id, text): equal components are near duplicates.

    Two texts link if the Jaccard similarity of their sets of word shingles is `similarity` or more; texts with the
    same words always do, and texts without words are one group. Every link is verified on whole shingle sets.

    Pairs are drawn twice. Fingerprints within two bits come from the pivot tables of links(), which finds most copies
    at little cost. Texts at 0.8 have fingerprints about 10 bits apart, too far for any pivot to tell from chance, so
    the others come from min-wise samples of the shingles (a pair at 0.8 shares one of 16 buckets with probability
    0.99999); no pair of a bucket is discarded but by its sizes, of which the smaller must be `similarity` of the larger.

    Copies are one row before buckets form. A bucket of up to PAIRED rows compares all pairs; in a larger one every
    row is first compared with two members chosen anew for each bucket. Pairs that are connected already are not
    compared. Rows of a larger bucket that are still in different groups are then all compared on whole shingle sets.
    A bucket that is one group by then takes work in proportion to its rows; one of rows that stay apart takes a
    comparison for each pair of them.
    """
    return _similar(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row_no"), words, similarity)


def _similar(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """similar_groups() of a written table (row_no, doc_id, text)."""
    tune(rows.sparkSession)
    seen = written(rows.mapInArrow(lambda it: _features(it, words), "row_no long, doc_id long, d1 long, d2 long, fp long, size long, bands array<long>"))
    with passing():
        placed = _placed(rows, seen, words, similarity)
    return seen.join(placed, ["d1", "d2"]).select("row_no", "doc_id", "component")


def _placed(rows: DataFrame, seen: DataFrame, words: int, similarity: float) -> DataFrame:
    """(d1, d2, component) of every text of `seen`; a table that outlives the scope of passing()."""
    distinct = written(seen.groupBy("d1", "d2").agg(F.min("row_no").alias("id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    spread = distinct.select("id", "size", F.posexplode("bands").alias("band", "key"))
    salted = F.struct(F.xxhash64("key", "id").alias("s"), "id", "size")
    sizes = spread.groupBy("key").agg(F.count("*").alias("n"), F.min(salted).alias("one"), F.max(salted).alias("two")).where("n > 1")
    met = written(spread.join(sizes, "key"))

    def near(x: str, y: str) -> Column:  # sets of such sizes can reach the similarity
        return F.least(f"{x}.size", f"{y}.size") >= similarity * F.greatest(f"{x}.size", f"{y}.size") - 1e-9

    heads = written(distinct.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("rep")))  # texts of one fingerprint meet at one of them
    own = distinct.select("fp", F.struct("id", "size").alias("me")).join(heads, "fp").where("me.id <> rep.id")
    close = links(heads.select("fp"))
    l, r = heads.select(F.col("fp").alias("a"), F.col("rep").alias("me")), heads.select(F.col("fp").alias("b"), "rep")
    printed = own.select("me", "rep").unionByName(close.join(l, "a").join(r, "b").select("me", "rep")).where(near("me", "rep"))

    few = met.where(F.col("n") <= PAIRED).select("key", "band", F.struct("id", "size").alias("me"))
    pairs = few.alias("l").join(few.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.me.id") < F.col("r.me.id")) & near("l.me", "r.me"))
    pairs = pairs.select(F.col("l.band").alias("band"), F.col("l.me.id").alias("a"), F.col("r.me.id").alias("b"))
    many = met.where(F.col("n") > PAIRED).select("band", F.struct("id", "size").alias("me"), F.explode(F.array("one", "two")).alias("rep"))
    stars = many.where((F.col("me.id") != F.col("rep.id")) & near("me", "rep")).select("band", "me", F.struct("rep.id", "rep.size").alias("rep")).unionByName(printed.select(F.lit(-1).alias("band"), "me", "rep"))
    stars = stars.select("band", F.least("me.id", "rep.id").alias("a"), F.greatest("me.id", "rep.id").alias("b"))
    pairs = written(pairs.unionByName(stars).groupBy("a", "b").agg(F.min("band").alias("band")))

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    sets = written(rows.join(wanted, F.col("row_no") == F.col("id"), "left_semi").select("row_no", "text").mapInArrow(lambda it: _sets(it, words), "id long, shingles binary"))

    found = None
    for first, last in ((-1, 0), (0, BANDS // 4), (BANDS // 4, BANDS)):
        todo = pairs.where((F.col("band") >= first) & (F.col("band") < last))
        if found is not None:
            known = components(found)
            l, r = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
            todo = todo.join(l, "a", "left").join(r, "b", "left").where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")
        todo = written(todo.select("a", "b"))
        used = todo.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        some = sets.join(F.broadcast(used), "id", "left_semi") if used.count() <= BROADCAST_ROWS else sets
        sided = todo.join(some.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(some.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        more = written(sided.select("a", "b", "x", "y").mapInArrow(lambda it: _alike(it, similarity), "a long, b long"))
        found = more if found is None else found.unionByName(more)
    groups = components(found)
    more = _rest_links(rows, met.where(F.col("n") > PAIRED).select("key", "id", "size"), groups, words, similarity)
    if more is not None:
        groups = components(found.unionByName(more))
    placed = distinct.select("d1", "d2", "id").join(groups, F.col("id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    return written(placed, stays=True)


def _rest_links(rows: DataFrame, hot: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame | None:
    """Links between rows that share a bucket of `hot` (key, id, size) and are in different groups so far.

    Rows outside a bucket's largest group are compared with all its rows on whole shingle sets; both sides are dealt
    in blocks of bounded size, so a bucket spreads over tasks. Buckets of one group need no work.
    """
    known = groups.select(F.col("node").alias("id"), "component")
    hot = written(hot.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
    parts = hot.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    by_key = parts.groupBy("key").agg(F.max(F.struct("n", "size", "component")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    by_key = by_key.where("n > most.n")

    def sides(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / SIDE_ROWS, size / SIDE_SHINGLES)).cast("long")

    cuts = by_key.select("key", F.col("most.component").alias("top"), sides(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("l"), sides(F.col("n"), F.col("size")).alias("r"))
    met = written(hot.join(cuts, "key"))
    ids = written(met.select("id").distinct())
    if not ids.limit(1).count():
        return None
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    sets = written(rows.join(wanted, F.col("row_no") == F.col("id"), "left_semi").select("row_no", "text").mapInArrow(lambda it: _sets(it, words), "id long, shingles binary"))

    def dealt(some: DataFrame, rest: bool) -> DataFrame:
        own, others = ("l", "r") if rest else ("r", "l")
        at = F.pmod(F.xxhash64("id", "key"), F.greatest(F.col(own), F.lit(1))).alias(own)
        return some.select("key", "id", "component", F.lit(rest).alias("rest"), at, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(others), F.lit(1)) - 1)).alias(others))

    blocks = dealt(met.where("component <> top"), True).unionByName(dealt(met, False))
    full = blocks.join(sets, "id").select("key", "l", "r", "id", "component", "rest", "shingles")
    return written(full.groupBy("key", "l", "r").applyInArrow(lambda t: _block_links(t, similarity), "a long, b long").distinct())


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row left of each group of similar_groups(): the smallest doc_id, then the earliest row.

    Rows kept are marked in bitmaps by row number, 4 KB for each 32,768 rows of a partition, so whole texts need no
    shuffle up to BITMAPS of them.
    """
    pinned = numbered(docs, "_textloom_row")
    bucket = F.bitmap_bucket_number("_textloom_row").alias("_textloom_bucket")
    with passing():
        found = _similar(pinned.select(F.col("_textloom_row").alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, similarity)
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")
        kept = found.groupBy("component").agg(F.min(order).alias("kept")).select(F.col("kept.row_no").alias("_textloom_row"))
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("_textloom_row")).alias("_textloom_bits")
        bitmaps = written(kept.groupBy(bucket).agg(bits), stays=True)
    if bitmaps.count() <= BITMAPS:
        bitmaps = F.broadcast(bitmaps)
    at = F.bitmap_bit_position("_textloom_row")
    byte = F.conv(F.hex(F.substring("_textloom_bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = pinned.select("*", bucket).join(bitmaps, "_textloom_bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return held.select(*docs.columns)
