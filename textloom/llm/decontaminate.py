"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, tune

SHORT = 16  # items of fewer bytes are found as whole words only, without edits
BUDGET = 0.08  # edits allowed, as a share of an item's bytes
BLOCK_BYTES = 32 << 20  # bytes of items matched in one pass over the documents; more take more passes
SLICE = 4 << 20  # bytes of a text looked up at once


def normalised(text: str | None) -> bytes:
    """Lower case, runs of white space as one space, UTF-8."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def word_byte(b: int) -> bool:
    """Whether a byte belongs to a word: letters and digits of ASCII, and all bytes of other characters."""
    return b >= 128 or 48 <= b <= 57 or 97 <= b <= 122


def best_end(item: bytes, window: bytes, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the closest substring of window within budget edits, by Myers (1999); None if there is none."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (budget + 1, -1)
    for j, c in enumerate(window):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= budget else None


class Matcher:
    """Exact look-up of the pieces of a block of items, with verification."""

    def __init__(self, items: list[tuple[int, str]], budget: float) -> None:
        import numpy as np

        self.np, self.items, self.heads, self.words = np, [], {}, {}
        for item_id, text in items:
            b = normalised(text)
            if len(b) < SHORT:
                if b:
                    self.words.setdefault(b, []).append(len(self.items))
                    self.items.append((item_id, b, 0))
                continue
            k = int(len(b) * budget) + 1
            cuts = [len(b) * j // k for j in range(k + 1)]
            at = len(self.items)
            self.items.append((item_id, b, k - 1))
            for x, y in zip(cuts, cuts[1:]):
                self.heads.setdefault(int.from_bytes(b[x : x + 8], "little"), []).append((at, x, b[x:y]))
        self.bits = max(16, (16 * len(self.heads)).bit_length())  # one slot in 16 at most is taken
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.short = None
        if self.words:
            import ahocorasick

            self.short = ahocorasick.Automaton()
            for w in self.words:
                self.short.add_word(w.decode("latin-1"), w)
            self.short.make_automaton()
        self.seen[self.slots(np.array(list(self.heads), dtype="<u8"))] = True

    def slots(self, words):
        return (words * self.np.uint64(0x9E3779B97F4A7C15)) >> self.np.uint64(64 - self.bits)

    def hits(self, text: bytes) -> Iterator[int]:
        """Places at which the first eight bytes of a piece may stand."""
        np = self.np
        for base in range(0, max(len(text) - 7, 0), SLICE):
            part = text[base : base + SLICE + 7]
            for shift in range(8):
                words = np.frombuffer(part, dtype="<u8", offset=shift, count=(len(part) - shift) // 8)
                for i in np.flatnonzero(self.seen[self.slots(words)]).tolist():
                    yield base + shift + 8 * i

    def match(self, text: bytes, first: bool = False) -> dict[int, tuple[int, int]]:
        """Closest match (distance, end) of each item in a normalised text; with `first`, any one match will do."""
        found: dict[int, tuple[int, int]] = {}
        if self.short is not None and text:
            for end, w in self.short.iter(text.decode("latin-1")):
                at = end - len(w) + 1
                if not (at and word_byte(text[at - 1]) and word_byte(w[0])) and not (end + 1 < len(text) and word_byte(text[end + 1]) and word_byte(w[-1])):
                    for i in self.words[w]:
                        found.setdefault(i, (0, end + 1))
                    if first:
                        return found
        tried: dict[int, list[tuple[int, int]]] = {}
        for p in self.hits(text):
            for at, x, piece in self.heads.get(int.from_bytes(text[p : p + 8], "little"), ()):
                _, item, k = self.items[at]
                if found.get(at, (1,))[0] == 0 or not text.startswith(piece, p):
                    continue
                start = p - x
                if start >= 0 and text.startswith(item, start):
                    found[at] = (0, start + len(item))
                    if first:
                        return found
                    continue
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                if any(a <= lo and hi <= b for a, b in tried.get(at, ())):
                    continue
                lo, hi = max(0, lo - k), min(len(text), hi + k)  # a little more, so that neighbouring hits share a trial
                tried.setdefault(at, []).append((lo, hi))
                if got := best_end(item, text[lo:hi], k):
                    found[at] = min(found.get(at, (k + 1, 0)), (got[0], lo + got[1]))
                    if first:
                        return found
        return found


def _matches(batches: Iterator[pa.RecordBatch], items, budget: float) -> Iterator[pa.RecordBatch]:
    m = Matcher(items.value, budget)
    names = ["doc_id", "item_id", "distance", "match_end"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for b in batches:
        out = []
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
            for at, (d, end) in m.match(normalised(text.as_py())).items():
                out.append((doc_id, m.items[at][0], d, end))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_BYTES; one empty block if there are none."""
    block, size, any_ = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size, any_ = [], 0, True
    if block or not any_:
        yield block


def _check(budget: float) -> None:
    if not 0 <= budget <= 0.08:
        raise ValueError("budgets over 0.08 make pieces shorter than eight bytes")


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(doc_id, item_id, distance, match_end): each document that holds an item within budget x bytes edits.

    docs (doc_id, text), benchmark (item_id, text). Texts are compared in lower case with white space runs as one
    space; distance counts UTF-8 bytes; match_end is the end of the closest match in the normalised text. An item
    is cut into one piece more than its edit budget, so any match holds one piece unchanged; pieces are at least
    eight bytes. Items under SHORT bytes match without edits, and only where no word goes on before or after them
    (match_end: of the first one). Null and empty items take no part; null documents match nothing; repeated items and
    repeated rows are each reported. Items go to executors in blocks of bounded size, one pass over docs a block.
    """
    _check(budget)
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, match_end long"

    def one(block: list) -> DataFrame:
        sent = Sent(spark, block)
        return rows.mapInArrow(lambda it: _matches(it, sent, budget), schema)

    return reduce(lambda a, b: a.unionByName(b), map(one, _blocks(benchmark)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """docs without the rows that hold a benchmark item, as contaminated() finds them; all columns kept.

    Rows are dropped where they are read: each block of items is a filter over the rows that the ones before left.
    """
    _check(budget)
    spark = docs.sparkSession
    tune(spark)
    names = docs.columns
    at = [c.lower() for c in names].index("text")

    def clean(sent):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(sent.value, budget)
            for b in batches:
                yield b.filter(pa.array([not m.match(normalised(t.as_py()), first=True) for t in b.column(at)], pa.bool_()))

        return keep

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(clean(Sent(spark, block)), docs.schema)
    return docs
