"""Approximate nearest neighbours: stable projections in kd-trees, with a chi-square stopping test.

Vectors are projected to PROJECTIONS Gaussian (2-stable) coordinates. A kd-tree over a sample of the projections parts
space into cells, a cell's vectors go to blocks of bounded size, and each block has a kd-tree of its own. The squared
projected distance of a pair over its squared distance is chi-square distributed. A search verifies vectors in order
of projected distance and ends when a vector nearer than the k-th found would have come by now with the confidence
asked for. One bound serves all blocks: a query visits its own block first, and takes the k-th distance found there to
the others, of which it only visits those whose boxes the test can't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sent, tune, written

PROJECTIONS = 16  # even, for the closed form of the distribution
CONFIDENCE = 0.95  # with which a vector that is RATIO times nearer than the k-th found is seen before a search ends
RATIO = 1.05
BLOCK = 16_384  # vectors of a block, about
LEAF = 128
SAMPLE = 20_000  # projections that cells are cut from
STEP = 1024  # vectors verified between two stopping tests


def chi_square(x: float, m: int = PROJECTIONS) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int = PROJECTIONS) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def reach(confidence: float, ratio: float) -> float:
    """Squared projected distance at which a search ends, over the squared k-th distance."""
    return quantile(confidence) / ratio**2


def projection(dim: int):
    import numpy as np

    return np.random.default_rng([2024, dim]).standard_normal((dim, PROJECTIONS))


def split(points, leaf: int) -> tuple[list, object]:
    """kd-tree over points, cut at medians of the widest axis: (nodes, order).

    A node is (axis, value, left, right), or (None, start, stop, leaf number) with its points at order[start:stop].
    """
    import numpy as np

    order, nodes, leaves = np.arange(len(points)), [], 0
    stack = [(0, len(points), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        p = points[order[a:b]]
        axis = int((p.max(axis=0) - p.min(axis=0)).argmax()) if b > a else 0
        mid = (b - a) // 2
        value = float(np.partition(p[:, axis], mid)[mid]) if b - a > leaf else 0.0
        below = p[:, axis] < value
        if b - a <= leaf or not below.any():
            nodes.append([None, a, b, leaves])
            leaves += 1
            continue
        order[a:b] = np.concatenate([order[a:b][below], order[a:b][~below]])
        nodes.append([axis, value, -1, -1])
        cut = a + int(below.sum())
        stack += [(a, cut, me, 0), (cut, b, me, 1)]
    return nodes, order


def leaf_of(nodes: list, points):
    """Number of the leaf that each point falls into."""
    import numpy as np

    out = np.zeros(len(points), dtype=np.int32)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        axis, x, left, right = nodes[at]
        if axis is None:
            out[rows] = right
        elif len(rows):
            below = points[rows, axis] < x
            stack += [(left, rows[below]), (right, rows[~below])]
    return out


def gaps(low, high, at):
    """Squared distances from a point to boxes."""
    import numpy as np

    gap = np.maximum(0, np.maximum(low - at, at - high))
    return (gap * gap).sum(axis=1)


class Tree:
    """kd-tree over the projections of a block of vectors."""

    def __init__(self, rows, ids, vectors) -> None:
        import numpy as np

        points = vectors @ projection(vectors.shape[1])
        nodes, order = split(points, LEAF)
        self.rows, self.ids = np.asarray(rows)[order], np.asarray(ids, dtype=float)[order]  # a null id comes last
        self.vectors, self.points = np.ascontiguousarray(vectors[order]), np.ascontiguousarray(points[order])
        spans = sorted((a, b) for axis, a, b, _ in nodes if axis is None)
        self.starts = np.array([a for a, _ in spans] + [len(order)])
        self.low, self.high = (f.reduceat(self.points, self.starts[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.verified = 0

    def search(self, query, k: int, enough: float, bound: float = math.inf, skip: int = -1):
        """(places, distances) of the k nearest found, nearest first, ties to the smaller id.

        bound: a k-th squared distance known from elsewhere; skip: the query's own row.
        """
        import numpy as np

        at = query @ projection(len(query))
        slack = 1e-9 * float(at @ at)  # copies are at distance zero but for rounding
        near = np.flatnonzero(np.repeat(gaps(self.low, self.high, at) <= enough * bound + slack, np.diff(self.starts)))
        gap = self.points[near] - at
        far = np.einsum("ij,ij->i", gap, gap)
        near, far = near[far <= enough * bound + slack], far[far <= enough * bound + slack]
        order = np.argsort(far, kind="stable")
        near, far = near[order], far[order]
        best, squares = np.empty(0, dtype=np.int64), np.empty(0)
        for i in range(0, len(near), STEP):
            if far[i] > enough * bound + slack:
                break
            some = near[i : i + STEP]
            some = some[self.rows[some] != skip]
            diff = self.vectors[some] - query
            self.verified += len(some)
            best, squares = np.concatenate([best, some]), np.concatenate([squares, (diff * diff).sum(axis=1)])
            keep = np.lexsort((self.rows[best], self.ids[best], squares))[:k]
            best, squares = best[keep], squares[keep]
            if len(best) == k:
                bound = min(bound, float(squares[-1]))
        return best.tolist(), np.sqrt(squares).tolist()


PINNED = "row_no long, vec_id long, asks boolean, dim int, embedding array<double>, point array<double>"


def _matrix(column):
    """A list column of equally long lists as a matrix."""
    import numpy as np

    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for b in batches:
        table = pa.Table.from_batches([b])
        for dim in pc.unique(b["dim"]).to_pylist():
            part = table.filter(pc.equal(table["dim"], dim)).combine_chunks()
            points = _matrix(part["embedding"].combine_chunks()) @ projection(dim)
            lists = pa.ListArray.from_arrays(pa.array(range(0, points.size + 1, PROJECTIONS), pa.int32()), pa.array(points.ravel()))
            yield from part.append_column("point", lists).to_batches()


def _cells(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    import numpy as np

    trees = sent.value
    for b in batches:
        points, dims, cell = _matrix(b["point"]), b["dim"].to_numpy(), np.zeros(b.num_rows, dtype=np.int32)
        for dim in np.unique(dims).tolist():
            if dim in trees:
                cell[dims == dim] = leaf_of(trees[dim], points[dims == dim])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])


def _visits(batches: Iterator[pa.RecordBatch], sent, enough: float) -> Iterator[pa.RecordBatch]:
    """Each query with every block that its bound doesn't rule out, but for the one it has been to."""
    import numpy as np

    boxes = sent.value
    for b in batches:
        points, row, cell, sub = _matrix(b["point"]), [], [], []
        for i, (dim, home, own, bound) in enumerate(zip(*(b[c].to_pylist() for c in ("dim", "cell", "sub", "bound")))):
            cells, low, high, subs = boxes[dim]
            for c in np.flatnonzero(gaps(low, high, points[i]) <= enough * (math.inf if bound is None else bound) + 1e-9 * float(points[i] @ points[i])).tolist():
                for s in range(subs[c]):
                    if (cells[c], s) != (home, own):
                        row.append(i), cell.append(cells[c]), sub.append(s)
        some = b.select(["row_no", "vec_id", "dim", "embedding", "bound"]).take(pa.array(row, pa.int32()))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(sub, pa.int32())], names=[*some.schema.names, "cell", "sub"])


FOUND = "query_row long, query_id long, row_no long, vec_id long, score double"


def _search(batches: Iterator[pa.RecordBatch], k: int, enough: float) -> Iterator[pa.RecordBatch]:
    """Answers of each block; rows come sorted by block, its vectors before its queries, which are not held."""
    import numpy as np
    import pyarrow.compute as pc

    block, parts, tree = None, [], None
    for b in batches:
        out: list[tuple] = []
        keys = list(zip(b["dim"].to_pylist(), b["cell"].to_pylist(), b["sub"].to_pylist(), b["kind"].to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            some, key = b.slice(lo, hi - lo), keys[lo]
            if key[:3] != block:
                block, parts, tree = key[:3], [], None
            matrix, rows = _matrix(some["embedding"]), some["row_no"].to_numpy()
            if key[3] == 0:
                parts.append((rows, pc.fill_null(some["vec_id"].cast(pa.float64()), math.inf).to_numpy(), some["vec_id"].to_pylist(), matrix))
                continue
            if not parts:
                continue
            if tree is None:
                tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[3] for p in parts]))
                names = dict(zip(np.concatenate([p[0] for p in parts]).tolist(), [x for p in parts for x in p[2]]))
                parts = parts[:1]
            for q, row, q_id, bound in zip(matrix, rows.tolist(), some["vec_id"].to_pylist(), some["bound"].to_pylist()):
                places, scores = tree.search(q, k, enough, math.inf if bound is None else bound, row)
                out += [(row, q_id, r, names[r], s) for r, s in zip(tree.rows[places].tolist(), scores)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=[c.split()[0] for c in FOUND.split(", ")])


def nearest(vectors: DataFrame, is_query: "F.Column", k: int = 10, confidence: float = CONFIDENCE, ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k nearest rows found for each query row, Euclidean distance.

    vectors (vec_id, embedding). A row is not its own neighbour; repeated rows and ids are rows like others. Vectors
    that are null, empty or zero, or hold null or non-finite components, take no part. Only vectors of the same
    dimension are compared. Ties go to the smaller vec_id, null ids last. Other columns are not looked at.

    Cells come from at most SAMPLE projections; every row is indexed. Vectors and queries meet by block key in sorted
    partitions, so no query passes through the driver, a task holds one block, and a cell that a common vector fills
    is dealt over many blocks. A query takes k rows of each block it visits to the final ranking.
    """
    spark = vectors.sparkSession
    tune(spark)
    enough = reach(confidence, ratio)
    v = F.col("embedding")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(usable).select("row_no", "vec_id", "asks", F.size(v).alias("dim"), "embedding")
    pinned = written(rows.mapInArrow(_project, PINNED))  # row numbers stay as they are, however often the table is read

    dims = {r["dim"]: r["count"] for r in pinned.groupBy("dim").count().collect()}
    drawn = pinned.select("dim", "point", F.xxhash64("row_no").alias("h"), "row_no").orderBy("h", "row_no").limit(SAMPLE).select("dim", "point").toArrow()
    trees = {}
    for dim, n in dims.items():
        points = _matrix(drawn.filter(pa.compute.equal(drawn["dim"], dim))["point"].combine_chunks())
        if len(points) and n > BLOCK:
            trees[dim] = split(points, max(32, math.ceil(len(points) * BLOCK / n)))[0]
    sent = Sent(spark, trees)  # at most SAMPLE / 32 cells
    placed = written(pinned.mapInArrow(lambda it: _cells(it, sent), PINNED + ", cell int"))
    edges = [f(F.col("point")[i]).alias(f"{f.__name__}{i}") for i in range(PROJECTIONS) for f in (F.min, F.max)]
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), *edges).orderBy("dim", "cell").collect()
    boxes: dict = {}
    for r in cells:
        box = boxes.setdefault(r["dim"], ([], [], [], []))
        for at, x in zip(box, (r["cell"], [r[f"min{i}"] for i in range(PROJECTIONS)], [r[f"max{i}"] for i in range(PROJECTIONS)], math.ceil(r["n"] / BLOCK))):
            at.append(x)
    import numpy as np

    boxes = {d: (c, np.array(lo), np.array(hi), s) for d, (c, lo, hi, s) in boxes.items()}
    subs = spark.createDataFrame([(d, c, s) for d, (cs, _, _, ss) in boxes.items() for c, s in zip(cs, ss)], "dim int, cell int, subs int")
    placed = placed.join(F.broadcast(subs), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row_no"), F.col("subs")).cast("int"))
    shape = ["dim", "cell", "sub", "row_no", "vec_id", "embedding"]
    held = placed.select(*shape, F.lit(None).cast("double").alias("bound"), F.lit(0).alias("kind"))

    def answers(queries: DataFrame) -> DataFrame:
        both = held.unionByName(queries.select(*shape, "bound", F.lit(1).alias("kind")))
        return written(both.repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "kind").mapInArrow(lambda it: _search(it, k, enough), FOUND))

    asking = placed.where("asks")
    near = answers(asking.withColumn("bound", F.lit(None).cast("double")))
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row_no")
    kth = near.groupBy("query_row").agg(F.count("*").alias("n"), F.max("score").alias("s")).where(F.col("n") >= k).select(F.col("query_row").alias("row_no"), F.expr("s * s * (1 + 1e-12)").alias("bound"))
    where = Sent(spark, boxes)
    going = asking.join(kth, "row_no", "left").select("row_no", "vec_id", "dim", "embedding", "point", "bound", "cell", "sub")
    far = answers(going.mapInArrow(lambda it: _visits(it, where, enough), "row_no long, vec_id long, dim int, embedding array<double>, bound double, cell int, sub int"))
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")
