"""Exact removal of repeated passages by prefix-free parsing.

The corpus is parsed at triggers, words of WORD bytes whose hash is small; where a whole window has none, its least
word counts as one. Every window of WINDOW bytes thus has one anchor that depends on its own bytes alone: its first
trigger. The starts of windows fall into phrases, runs of starts with the same anchor, and a phrase with all its
windows is one context (the bytes before its anchor, the bytes from its anchor on).

Contexts are the dictionary: equal ones are counted, not compared. Only contexts that share the HALF bytes next to
their anchor with a different context can still have windows in common. For these, the suffix array of the right
sides (the parse, in corpus order from the anchor on) and the suffix array of the left sides (phrase suffixes, read
backwards from the anchor) are built with their common prefix lengths; window l before the anchor is repeated if
another context lies in the same run of at least l common bytes in one and WINDOW - l in the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tune, written

WINDOW = 200
WORD = 8
DENSITY = 64  # one word in so many is a trigger
HALF = 100
CHUNK = 4 << 20  # bytes of text in one chunk of documents, at least (unless it is the last)
HOT = 5_000  # a key with more contexts than this compares windows by hash, which needs no group in memory
ROWS = 20_000  # contexts sorted at once
SLICE = 1 << 20

CONTEXT = "key long, x long, n long, chunk long, at long, lo int, hi int, left binary, right binary, starts array<long>"


def mixed(buf: bytes, start: int, stop: int):
    """Hashes of the WORD bytes at each place from start to stop; buf has 16 bytes more than its text."""
    import numpy as np

    n = stop - start
    words = np.empty(n, dtype=np.uint64)
    for s in range(min(8, n)):
        words[s::8] = np.frombuffer(buf, dtype="<u8", offset=start + s, count=(n - s + 7) // 8)
    words *= np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    words ^= words >> np.uint64(32)
    return words


def phrases(buf: bytes, offsets):
    """(anchor, first start, last start) of all phrases of the texts that stand end to end in buf.

    offsets: where each text starts, and the end of the last. A window never leaves its text.
    """
    import numpy as np

    n, small = int(offsets[-1]), np.uint64((1 << 64) // DENSITY)
    found = [np.flatnonzero(mixed(buf, a, min(n, a + SLICE)) < small) + a for a in range(0, n, SLICE)]
    trig = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    starts, ends = offsets[:-1][np.diff(offsets) >= WINDOW], offsets[1:][np.diff(offsets) >= WINDOW]
    if not len(starts):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    doc = np.searchsorted(starts, trig, side="right") - 1
    inside = (doc >= 0) & (trig < ends[np.maximum(doc, 0)])
    trig, doc = trig[inside], doc[inside]
    before = np.concatenate([[-1], trig[:-1]])
    first = np.maximum(np.maximum(before + 1, trig - (WINDOW - WORD)), starts[doc])
    last = np.minimum(trig, ends[doc] - WINDOW)
    ok = first <= last
    anchor, first, last = [trig[ok]], [first[ok]], [last[ok]]

    # windows without a trigger: between two triggers, or a trigger and an end of the text
    lead = np.concatenate([trig, starts - 1])
    where = np.concatenate([doc, np.arange(len(starts))])
    follows = np.concatenate([trig, [1 << 62]])[np.searchsorted(trig, lead + 1)]
    lo, hi = lead + 1, np.minimum(follows - (WINDOW - WORD) - 1, ends[where] - WINDOW)
    more: list[tuple[int, int, int]] = []
    width = WINDOW - WORD + 1
    for a, b in zip(lo[lo <= hi].tolist(), hi[lo <= hi].tolist()):
        at, run = -1, a
        for x in range(a, b + 1, SLICE // 16):
            y = min(b + 1, x + SLICE // 16)
            least = np.lib.stride_tricks.sliding_window_view(mixed(buf, x, y + width - 1), width).argmin(axis=1) + np.arange(x, y)
            cut = np.flatnonzero(np.diff(least, prepend=at))
            for i in cut.tolist():
                if at >= 0:
                    more.append((at, run, x + i - 1))
                at, run = int(least[i]), x + i
        more.append((at, run, b))
    if more:
        m = np.array(more, dtype=np.int64)
        anchor, first, last = [*anchor, m[:, 0]], [*first, m[:, 1]], [*last, m[:, 2]]
    return np.concatenate(anchor), np.concatenate(first), np.concatenate(last)


class Parse:
    """All contexts of a chunk: anchor, most and least bytes before it at which a window starts, key and hash.

    A context's windows that reach at most HALF bytes before the anchor share the HALF bytes after it; the others
    share the HALF + 1 bytes before it. These shared bytes are the key; x is a hash of the whole context.
    """

    def __init__(self, buf: bytes, offsets) -> None:
        import numpy as np
        import xxhash

        h = xxhash.xxh3_64_intdigest
        at, first, last = phrases(buf, offsets)
        most, least = at - first, at - last
        near, far = least <= HALF, most > HALF
        self.at = np.concatenate([at[near], at[far]])
        self.lo = np.concatenate([np.minimum(most[near], HALF), most[far]])
        self.hi = np.concatenate([least[near], np.maximum(least[far], HALF + 1)])
        keys = [h(buf[i : i + HALF], 1) for i in at[near].tolist()] + [h(buf[i - HALF - 1 : i + WORD], 2) for i in at[far].tolist()]
        xs = [h(buf[i:j], s) for i, j, s in zip((self.at - self.lo).tolist(), (self.at - self.hi + WINDOW).tolist(), self.lo.tolist())]
        self.key = np.array(keys, dtype=np.uint64).view(np.int64)
        self.x = np.array(xs, dtype=np.uint64).view(np.int64)

    def __len__(self) -> int:
        return len(self.at)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole rows, all columns included, as compressed Arrow streams."""
    from pyspark import TaskContext

    part, held, size, count = TaskContext.get().partitionId(), [], 0, 0

    def row() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in pa.Table.from_batches(held).combine_chunks().to_batches():
                out.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "content"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += pc.sum(pc.binary_length(b["text"])).as_py() or 0
            if size >= CHUNK:
                yield row()
                held, size, count = [], 0, count + 1
    if held:
        yield row()


def _open(content: bytes):
    """(table, bytes of all texts and 16 more, offsets) of a chunk."""
    import numpy as np

    table = pa.ipc.open_stream(content).read_all()
    texts = pc.fill_null(table["text"].cast(pa.large_string()), "").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[int(offsets[0]) : int(offsets[-1])] if offsets[-1] > offsets[0] else b""
    return table, data + bytes(16), offsets - offsets[0]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        for chunk, content in zip(b["chunk"].to_pylist(), b["content"]):
            _, buf, offsets = _open(content.as_py())
            p = Parse(buf, offsets)
            order = np.lexsort((p.x, p.key))
            key, x = p.key[order], p.x[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1])])) if len(key) else np.empty(0, dtype=np.int64)
            n = np.diff(np.append(new, len(key)))
            for i in range(0, len(new), 100_000):
                s = new[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(x[s]), pa.array(np.full(len(s), chunk)), pa.array(n[i : i + 100_000].astype(np.int32))], names=["key", "x", "chunk", "n"])


def _requested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for; for hot keys, each window by its hash instead."""
    import xxhash

    h = xxhash.xxh3_128_intdigest
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in CONTEXT.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for b in batches:
        for chunk, content, needs in zip(b["chunk"].to_pylist(), b["content"], b["needs"].to_pylist()):
            _, buf, offsets = _open(content.as_py())
            p = Parse(buf, offsets)
            asked = {(r["key"], r["x"]): (r["n"], r["hot"]) for r in needs}
            rows, windows = [], {}
            for at, lo, hi, key, x in zip(p.at.tolist(), p.lo.tolist(), p.hi.tolist(), p.key.tolist(), p.x.tolist()):
                if (got := asked.pop((key, x), None)) is None:
                    continue
                n, hot = got
                if not hot:
                    rows.append((key, 0, n, chunk, at, lo, hi, buf[at - lo : at], buf[at : at + WINDOW - hi], None))
                    if len(rows) >= 5_000:
                        yield batch(rows)
                        rows = []
                    continue
                for s in range(at - lo, at - hi + 1):
                    w = windows.setdefault(h(buf[s : s + WINDOW]), [0, []])
                    w[0] += n
                    if n == 1:
                        w[1].append(s)
            for v, (n, starts) in windows.items():
                rows.append(((v >> 64) - (1 << 63), (v & (1 << 64) - 1) - (1 << 63), n, chunk, 0, 0, 0, None, None, starts))
                if len(rows) >= 5_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def _classes(group: list[int], sides: list[bytes], width: int):
    """Suffix array of the sides within their groups: (place of each row, common bytes with the row before it)."""
    import numpy as np

    m = len(sides)
    order = sorted(range(m), key=lambda i: (group[i], sides[i]))
    length = np.array([len(sides[i]) for i in order])
    matrix = np.frombuffer(b"".join(sides[i].ljust(width, b"\0") for i in order), dtype=np.uint8).reshape(m, width)
    differ = matrix[1:] != matrix[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(length[1:], length[:-1]))
    g = np.array(group)[order]
    lcp[g[1:] != g[:-1]] = -1
    place = np.empty(m, dtype=np.int64)
    place[order] = np.arange(m)
    return place, np.concatenate([[-1], lcp])


def repeated(group: list[int], n: list[int], lo: list[int], hi: list[int], left: list[bytes], right: list[bytes]):
    """For each context, which windows (bytes before its anchor) are also in another context, or in its own copies.

    Rows of a group share a key. Returns a matrix of rows x (WINDOW - WORD + 1).
    """
    import numpy as np

    m = len(group)
    lo, hi, n = np.array(lo), np.array(hi), np.array(n)
    lp, lcs = _classes(group, [s[::-1] for s in left], max(1, int(lo.max())))
    rp, lcp = _classes(group, right, WINDOW)
    out = np.zeros((m, WINDOW - WORD + 1), dtype=bool)
    for k in range(int(hi.min()), int(lo.max()) + 1):
        rows = np.flatnonzero((hi <= k) & (k <= lo))
        if not len(rows):
            continue
        ls, rs = np.cumsum(lcs < k)[lp[rows]], np.cumsum(lcp < WINDOW - k)[rp[rows]]
        _, which = np.unique(ls * (m + 1) + rs, return_inverse=True)
        out[rows, k] = np.bincount(which, weights=n[rows])[which] > 1
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches (chunk, start, stop) from contexts sorted by key; at most ROWS and one group in memory."""
    import numpy as np

    def marks(rows: pa.Table) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        hot = rows.filter(pc.is_valid(rows["starts"]))
        if hot.num_rows:
            total: dict[tuple[int, int], int] = {}
            pairs = list(zip(hot["key"].to_pylist(), hot["x"].to_pylist()))
            for p, n in zip(pairs, hot["n"].to_pylist()):
                total[p] = total.get(p, 0) + n
            for p, chunk, starts in zip(pairs, hot["chunk"].to_pylist(), hot["starts"].to_pylist()):
                if total[p] > 1:
                    out += [(chunk, s, s + WINDOW) for s in starts]
        cold = rows.filter(pc.is_null(rows["starts"]))
        if cold.num_rows:
            c = {k: cold[k].to_pylist() for k in ("key", "n", "chunk", "at", "lo", "hi", "left", "right")}
            found = repeated(c["key"], c["n"], c["lo"], c["hi"], c["left"], c["right"])
            found[np.array(c["n"]) > 1] = False  # whole contexts with copies are marked as such
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            out += [(c["chunk"][r], c["at"][r] - y + 1, c["at"][r] - x + WINDOW) for r, x, y in zip(row.tolist(), a.tolist(), b.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["chunk", "start", "stop"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < ROWS:
            continue
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if cut:
            yield marks(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        size = t.num_rows - cut
    if size:
        yield marks(pa.Table.from_batches(held))


def _removed(buf: bytes, offsets, alls: list[dict] | None, marks: list[dict] | None):
    """Which bytes of a chunk go."""
    import numpy as np

    n = int(offsets[-1])
    edge = np.zeros(n + 1, dtype=np.int32)
    if alls:
        p = Parse(buf, offsets)
        want = {(r["key"], r["x"]) for r in alls}
        hit = np.fromiter((k in want for k in zip(p.key.tolist(), p.x.tolist())), dtype=bool, count=len(p))
        np.add.at(edge, (p.at - p.lo)[hit], 1)
        np.add.at(edge, (p.at - p.hi + WINDOW)[hit], -1)
    if marks:
        np.add.at(edge, np.array([r["start"] for r in marks]), 1)
        np.add.at(edge, np.array([r["stop"] for r in marks]), -1)
    return np.cumsum(edge)[:n] > 0


def _finish(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        for content, alls, marks in zip(b["content"], b["alls"].to_pylist(), b["marks"].to_pylist()):
            table, buf, offsets = _open(content.as_py())
            gone = _removed(buf, offsets, alls, marks)
            data = np.frombuffer(buf, dtype=np.uint8, count=len(gone))
            if as_text and gone.any():  # a letter goes only if all its bytes do
                letter = np.cumsum((data & 0xC0) != 0x80) - 1
                gone = (np.bincount(letter, weights=gone) == np.bincount(letter))[letter]
            total = np.concatenate([[0], np.cumsum(gone)])
            kept = data[~gone].tobytes()
            place = offsets - total[offsets]
            pieces = [kept[i:j] for i, j in zip(place[:-1].tolist(), place[1:].tolist())]
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            begins[offsets[:-1][offsets[:-1] < len(gone)]] = gone[offsets[:-1][offsets[:-1] < len(gone)]]
            runs = np.concatenate([[0], np.cumsum(begins)])
            extra = {"n_bytes": np.diff(offsets), "n_removed": np.diff(total[offsets]), "n_spans": np.diff(runs[offsets])}
            if as_text:
                at, null = table.schema.get_field_index("text"), table["text"].is_null().to_pylist()
                table = table.set_column(at, "text", pa.array([None if z else p.decode("utf-8", "replace") for z, p in zip(null, pieces)], pa.string()))
            else:
                table = table.drop_columns(["text"])
                table = table.append_column("kept_sha256", pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()))
            for k, v in extra.items():
                table = table.append_column(k, pa.array(v, pa.int64()))
            yield from table.to_batches(max_chunksize=1000)


def _dedup(docs: DataFrame, as_text: bool, schema: str, names: list[str]) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    chunks = written(docs.mapInArrow(_pack, "chunk long, content binary"))
    each = chunks.mapInArrow(_contexts, "key long, x long, chunk long, n int").repartition("key")
    first = F.row_number().over(Window.partitionBy("key", "x").orderBy("chunk")) == 1
    counted = each.select("*", first.alias("first"), F.sum("n").over(Window.partitionBy("key", "x")).alias("copies"))
    by_key = Window.partitionBy("key")
    counted = counted.select("*", F.sum(F.col("first").cast("int")).over(by_key).alias("contexts"), F.min("copies").over(by_key).alias("rarest"))
    need = F.col("first") & (F.col("contexts") > 1) & (F.col("rarest") == 1)
    known = counted.where(need | (F.col("copies") > 1)).groupBy("chunk").agg(
        F.collect_list(F.when(F.col("copies") > 1, F.struct("key", "x"))).alias("alls"),
        F.collect_list(F.when(need, F.struct("key", "x", F.col("copies").alias("n"), (F.col("contexts") > HOT).alias("hot")))).alias("needs"),
    )
    known = written(known)
    asked = chunks.join(known.where(F.size("needs") > 0).select("chunk", "needs"), "chunk").select("chunk", "content", "needs")
    near = asked.mapInArrow(_requested, CONTEXT).repartition("key").sortWithinPartitions("key")
    marks = near.mapInArrow(_compare, "chunk long, start long, stop long").groupBy("chunk").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    marks = written(marks)
    whole = chunks.join(known.select("chunk", "alls"), "chunk", "left").join(marks, "chunk", "left").select("content", "alls", "marks")
    return whole.mapInArrow(lambda it: _finish(it, as_text), schema).select(*names)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text).

    A byte goes if a string of WINDOW bytes that covers it also starts anywhere else in the corpus, in its own text
    too. Strings are judged on the input and never cross texts. Null and empty texts have no bytes; repeated rows
    remove each other; other columns are not looked at. No rows give no rows.

    Memory: a task holds one chunk of documents (or one longer document), or ROWS contexts and one group of HOT.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return _dedup(rows, False, "doc_id long, kept_sha256 string, n_bytes long, n_removed long, n_spans long", names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of `text` as in digests(), all columns and rows kept.

    A letter of several bytes goes only if all its bytes do, so the text stays valid; null stays null.
    """
    def column(f) -> str:
        return f"`{f.name}` {f.dataType.simpleString()}"

    names = [f"`{c}`" for c in docs.columns]
    clash = {"n_bytes", "n_removed", "n_spans"} & {c.lower() for c in docs.columns}
    if clash:  # the three counts are appended under these names
        back = {c: f"_kept_{c}" for c in docs.columns if c.lower() in clash}
        return without_repeats(docs.withColumnsRenamed(back)).withColumnsRenamed({v: k for k, v in back.items()})
    schema = ", ".join(map(column, docs.schema.fields)) + ", n_bytes long, n_removed long, n_spans long"
    return _dedup(docs.withColumn("text", F.col("text").cast("string")), True, schema, names)
