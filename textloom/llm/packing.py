"""Packing token sequences: cutting-stock column generation over the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sent, tune, written

CAPACITY = 2048
END = 1
#: Words of these letters alone are one word to the tokenizer, and already in its normal form once in lower case.
LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The letters that stand for bytes in a byte-level vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
CACHE = 400_000  # pieces of text between white space whose ids a worker keeps
UNIT = 8  # tails are counted in length classes of so many ids, rounded up
MAX_ROUNDS = 4000  # simplex rounds
GAP = 0.0005  # rounds end when the sequences needed are this close to the lower bound
FULL = 0.98  # patterns that leave more of a sequence open are not used; their pieces are laid end to end
BROADCAST_ROWS = 500_000


def price(value, capacity: int):
    """Unbounded knapsack: (best value, {length: copies}) for value[length], by dynamic programming over fill."""
    import numpy as np

    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        v = best[:c][::-1] + value[1 : c + 1]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], took[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = {}
    c = capacity
    while c:
        if took[c]:
            pattern[int(took[c])] = pattern.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return best[capacity], pattern


def patterns(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = MAX_ROUNDS, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Rounded-down (pattern, times) of the cutting-stock linear program, by column generation.

    demand: pieces by length (1..capacity-1). Never uses more pieces than there are. The revised simplex starts
    from one pattern a length; the knapsack prices columns; Farley's bound ends it early. Its size depends on the
    number of different lengths alone.
    """
    import numpy as np

    lengths = sorted(x for x, n in demand.items() if n > 0)
    if not lengths:
        return []
    at = {x: i for i, x in enumerate(lengths)}
    columns: list[dict[int, int]] = [{x: capacity // x} for x in lengths]
    first = np.array([capacity // x for x in lengths], dtype=float)
    inverse = np.diag(1 / first)
    used = np.array([demand[x] for x in lengths]) / first
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = duals + 1e-9 * np.array(lengths)
        worth, pattern = price(value, capacity)
        if worth <= 1 + gap:
            break
        column = np.zeros(len(lengths))
        for x, k in pattern.items():
            column[at[x]] = k
        moved = inverse @ column
        ok = moved > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, used / np.where(ok, moved, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * moved, 0)
        used[out] = step
        row = inverse[out] / moved[out]
        inverse -= np.outer(moved, row)
        inverse[out] = row
        columns[out] = pattern
    left = {x: demand[x] for x in lengths}
    chosen = []
    for i in np.argsort(-used):
        p = columns[i]
        n = min([int(used[i] + 1e-6), *(left[x] // k for x, k in p.items())])
        if n > 0:
            chosen.append((p, n))
            for x, k in p.items():
                left[x] -= n * k
    return chosen


class Plan:
    """Places of tails by (length, rank). Rounded patterns of length classes take the first ranks of each class; the
    pieces left stand end to end and are cut at sequence ends; the last part is cut into powers of two."""

    def __init__(self, demand: dict[int, int], full: int, capacity: int = CAPACITY, unit: int = UNIT) -> None:
        import bisect

        self.bisect, self.capacity, self.unit, self.slots = bisect.bisect_right, capacity, unit, {}
        self.before: dict[int, int] = {}  # pieces of the class that are shorter
        classes: dict[int, int] = {}
        for x in sorted(demand):
            c = -(-x // unit)
            self.before[x] = classes.get(c, 0)
            classes[c] = classes.get(c, 0) + demand[x]
        used, seq = dict.fromkeys(classes, 0), full
        for p, n in patterns(classes, capacity // unit):
            if sum(c * k for c, k in p.items()) < FULL * (capacity // unit):
                continue
            at = 0
            for c, k in sorted(p.items(), reverse=True):
                self.slots.setdefault(c, []).append((used[c], n, seq, at))
                used[c] += n * k
                at += k
            seq += n
        self.starts = {c: [s[0] for s in v] for c, v in self.slots.items()}
        self.taken = {x: min(max(used[-(-x // unit)] - self.before[x], 0), demand[x]) for x in demand}
        self.rest, at = {}, 0
        for x in sorted(demand):
            self.rest[x] = at
            at += (demand[x] - self.taken[x]) * x
        self.base, self.whole, self.tail = seq, at // capacity, []
        s, left, sid = self.whole * capacity, at % capacity, seq + self.whole
        for bit in range(capacity.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                self.tail.append((s, s + (1 << bit), sid))
                s, sid = s + (1 << bit), sid + 1

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, order in the sequence) of each part."""
        if rank < self.taken[length]:
            c, rank = -(-length // self.unit), rank + self.before[length]
            first, n, seq, at = self.slots[c][self.bisect(self.starts[c], rank) - 1]
            copy, which = divmod(rank - first, n)
            return [(0, length, seq + which, at + copy)]
        at = self.rest[length] + (rank - self.taken[length]) * length
        end, out, start = at + length, [], at
        while at < end:
            if at < self.whole * self.capacity:
                s, order = divmod(at, self.capacity)
                stop, sid = min(end, (s + 1) * self.capacity), self.base + s
            else:
                lo, hi, sid = next(t for t in self.tail if t[0] <= at < t[1])
                stop, order = min(end, hi), at - lo
            out.append((at - start, stop - at, sid, order))
            at = stop
        return out


class Ids(dict):
    """Ids of what stands between white space, as little-endian bytes, each encoded when it is first looked up.

    White space always parts this tokenizer's words. Words of Latin letters go to the merge model directly, which
    skips the normaliser's cost; everything else takes the tokenizer's own way.
    """

    def __init__(self, tokenizer, kind: str) -> None:
        super().__init__()
        self.tokenizer, self.code = tokenizer, "H" if kind == "<u2" else "I"
        self.stops = {c: self.encoded(c) for c in ".,"}

    def encoded(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, w: str) -> bytes:
        stem = w[:-1] if w[-1:] in (".", ",") else w
        if not LATIN(stem):
            out = self.encoded(w)
        else:
            low = stem.lower()  # the same word to the tokenizer, so both share an entry
            ids = self.get(low)
            if ids is None:
                found = self.tokenizer.model.tokenize(low if low.isascii() else "".join([BYTE_LETTERS[c] for c in low.encode()]))
                ids = self[low] = array(self.code, [t.id for t in found]).tobytes()
            out = ids if stem is w else ids + self.stops[w[-1]]
        self[w] = out
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self) > CACHE:
                self.clear()
            out.append(b"".join(map(self.__getitem__, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))))
        return out


def _tokens(batches: Iterator[pa.RecordBatch], model, capacity: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document; crc of its full pieces; its tail; its place among this task's documents with such a tail."""
    import os

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from pyspark import TaskContext
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model.value)
    kind = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
    part, ranks, fulls, known = TaskContext.get().partitionId(), [0] * capacity, 0, Ids(tok, kind)
    end = np.array([END], dtype=kind).tobytes()
    types = [("doc_id", pa.int64()), ("part", pa.int32()), ("tokens", pa.int64()), ("tail", pa.int32()), ("rank", pa.int64()), ("full_before", pa.int64()), ("full_crc", pa.list_(pa.int64())), ("ids", pa.binary())]
    for b in batches:
        texts = [t or "" for t in b["text"].to_pylist()]
        out: list[list] = [[] for _ in types]
        for doc_id, raw in zip(b["doc_id"].to_pylist(), known.of(texts)):
            ids = np.frombuffer(raw + end, dtype=kind).astype("<u4")
            n, tail = len(ids), len(ids) % capacity
            full = [zlib.crc32(ids[i : i + capacity]) for i in range(0, n - tail, capacity)]
            row = (doc_id, part, n, tail, ranks[tail], fulls, full, ids[n - tail :].astype(kind).tobytes())
            ranks[tail] += 1
            fulls += len(full)
            for o, v in zip(out, row):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, (_, t) in zip(out, types)], names=[n for n, _ in types])


def _pieces(batches: Iterator[pa.RecordBatch], plan, wide: bool, capacity: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    kind, p = "<u4" if wide else "<u2", plan.value
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "at"]
    for b in batches:
        out = []
        for r in b.to_pylist():
            for j, crc in enumerate(r["full_crc"]):
                out.append((r["doc_id"], j * capacity, capacity, crc, r["tokens"], r["full_seq"] + j, 0))
            if r["tail"]:
                ids, at = np.frombuffer(r["ids"], dtype=kind).astype("<u4"), r["tokens"] - r["tail"]
                for s, n, seq, off in p.place(r["tail"], r["rank"]):
                    out.append((r["doc_id"], at + s, n, zlib.crc32(ids[s : s + n]), r["tokens"], seq, off))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs (doc_id, text); null text is empty, and an empty document is its end id alone. Whole stretches of
    `capacity` ids fill a sequence each. Tails are counted by length (a histogram of fewer than `capacity`
    numbers), the driver solves the cutting-stock program over classes of 8 lengths, and ranks within a class are
    dealt to rounded patterns: these sequences lack up to 2 %. Pieces over are laid end to end and cut at sequence ends, the last stretch at powers of two, so
    they need no padding. Ranks and full-sequence numbers come from counts by task of the written token table,
    so no length, however common, is gathered or sorted. Repeated rows are rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    model = Sent(spark, text)
    from tokenizers import Tokenizer

    wide = Tokenizer.from_str(text).get_vocab_size() > 1 << 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, part int, tokens long, tail int, rank long, full_before long, full_crc array<long>, ids binary"
    t = written(rows.mapInArrow(lambda it: _tokens(it, model, capacity), schema))
    counts = written(t.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum(F.size("full_crc")).alias("full")))
    demand = {r["tail"]: r["n"] for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).where("tail > 0").collect()}  # < capacity rows
    full = counts.agg(F.sum("full")).first()[0] or 0
    plan = Sent(spark, Plan(demand, full, capacity))

    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("part").agg(F.sum("full").alias("f"))
    # parts are numbers of tasks; their running sum goes by blocks of 1024 so that no task holds more than that
    block = whole.withColumn("block", F.floor(F.col("part") / 1024))
    sums = block.groupBy("block").agg(F.sum("f").alias("f"), F.lit(0).alias("one"))
    base = sums.select("block", F.coalesce(F.sum("f").over(Window.partitionBy("one").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("f").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = block.withColumn("inner", inner).join(base, "block").select("part", (F.col("inner") + F.col("base")).alias("full_start"))
    offsets = written(counts.select("part", "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_start")).join(starts, "part"))
    small = offsets.count() <= BROADCAST_ROWS
    placed = t.join(F.broadcast(offsets) if small else offsets, ["part", "tail"]).select(
        "doc_id", "tokens", "tail", "full_crc", "ids", (F.col("rank") + F.col("rank_start")).alias("rank"), (F.col("full_before") + F.col("full_start")).alias("full_seq")
    )
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, at long"
    pieces = placed.mapInArrow(lambda it: _pieces(it, plan, wide, capacity), out)
    fill = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(fill), F.lit(0))).drop("at")
