"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table and a record index.

A bundle is a row of a Parquet table in the shared folder: `content` is a whole .warc.zst file that any
Zstandard reader can decompress, and `records` maps record identifiers to (frame, offset in the frame, length).
Spark writes the table, so it can lie in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, tune, written

FRAME_BYTES = 256 << 10  # plain bytes after which a frame ends
BUNDLE_BYTES = 16 << 20  # plain bytes after which a bundle ends
SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E

BUNDLE = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:int,length:int>>"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer of the seekable format: a skippable frame with (compressed, plain) sizes of all frames."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIP_MAGIC, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    each = 12 if flags & 0x80 else 8
    at, out, start = len(content) - 9 - n * each, [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", content, at + i * each)
        out.append((start, c, d))
        start += c
    return out


def record_bytes(kind: str, record_id: str, uri: str, date: str, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response",
    ]
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


class Bundler:
    """Collects records into frames and frames into bundles."""

    def __init__(self) -> None:
        import zstandard

        self.press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.start()

    def start(self) -> None:
        self.frames: list[tuple[int, int]] = []
        self.done: list[bytes] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.plain = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        self.plain += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.frames.append((len(packed), self.open_bytes))
            self.done.append(packed)
            self.open, self.open_bytes = [], 0

    def bundle(self) -> dict:
        self.end_frame()
        content = b"".join(self.done) + seek_table(self.frames)
        out = {"bundle": hashlib.sha256(content).hexdigest(), "content": content, "records": self.index}
        self.start()
        return out


def _write(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("bundle", pa.string()), ("content", pa.binary()),
        ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))),
    ])
    out = Bundler()
    for batch in batches:
        for r in batch.to_pylist():
            payload = (r["html"] or "").encode()
            digest = r["digest"].decode() if isinstance(r["digest"], bytes) else r["digest"]
            record_id = f"<urn:textloom:{r['row_no']}:{r['page_id']}>"
            refers = None if r["first"] else f"<urn:textloom:{r['ref_no']}:{r['ref_id']}>"
            uri = urllib.parse.quote(r["url"] or "about:blank", safe="%/:?#[]@!$&'()*+,;=~")
            kind = "response" if r["first"] else "revisit"
            out.add(record_id, record_bytes(kind, record_id, uri, date, digest, len(payload), payload, refers))
            if out.plain >= BUNDLE_BYTES:
                yield pa.RecordBatch.from_pylist([out.bundle()], schema=schema)
    if out.plain:
        yield pa.RecordBatch.from_pylist([out.bundle()], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import base64

    import zstandard

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = re.compile(r"<urn:textloom:[^:]*:([^>]*)>")
    as_id = lambda x: None if x == "None" else int(x)
    for batch in batches:
        for i in range(batch.num_rows):
            content, index = batch["content"][i].as_py(), batch["records"][i].as_py()
            frames, plain, at = read_seek_table(content), b"", -1
            rows = []
            for r in index:
                if r["frame"] != at:
                    at = r["frame"]
                    start, packed, _ = frames[at]
                    plain = zstandard.ZstdDecompressor().decompress(content[start : start + packed])
                headers, payload = parse_record(plain[r["offset"] : r["offset"] + r["length"]])
                if headers["warc-record-id"] != r["record_id"]:
                    raise ValueError(f"the index points to {headers['warc-record-id']}, not {r['record_id']}")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {r['record_id']} differs from its digest")
                refers = headers.get("warc-refers-to")
                rows.append({
                    "page_id": as_id(number.fullmatch(r["record_id"])[1]), "payload_bytes": int(headers["warc-payload-length"]),
                    "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": as_id(number.fullmatch(refers)[1]) if refers else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def base32(hex_digest: "F.Column") -> "F.Column":
    """RFC 4648 base32 of a 40-digit hexadecimal SHA-1, with built-in functions."""
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for i in range(0, 40, 10):  # 10 hex digits are 40 bits, 8 letters
        n = F.conv(F.substring(hex_digest, i + 1, 10), 16, 10).cast("long")
        groups += [F.substring(F.lit(chars), (F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*groups)


def write_bundles(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """Writes each row (page_id, url, html) as a record; returns the written table of bundles.

    Of rows with equal payloads of at least min_bytes, the one with the largest page_id is the response and the
    others are revisits without payload; among repeated rows with that page_id one is the response. Null html is
    an empty payload, null url is about:blank, a null page_id is smaller than all others. No rows, no bundles.

    Payloads are found equal by SHA-1 and length. Only (digest, page_id) pairs are aggregated, with map-side
    maxima, so a payload held by a third of all rows is one small row from each task.
    """
    tune(pages.sparkSession)
    html = F.coalesce("html", F.lit("")).cast("binary")
    pinned = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "row_no")
    rows = pinned.select("page_id", "url", "html", F.sha1(html).alias("_hex"), F.octet_length(html).alias("_n"), "row_no")
    first = rows.groupBy("_hex", "_n").agg(F.max(F.struct("page_id", "row_no")).alias("_ref"), F.count("*").alias("_copies"))
    many = first.where((F.col("_copies") > 1) & (F.col("_n") >= min_bytes)).select("_hex", "_n", "_ref")
    # a row needs its group only where the group has more than one member
    marked = rows.select("row_no", "_hex", "_n").join(many, ["_hex", "_n"]).where(F.col("row_no") != F.col("_ref.row_no")).select("row_no", F.col("_ref.row_no").alias("ref_no"), F.col("_ref.page_id").alias("ref_id"))
    marked = written(marked)
    flagged = rows.join(marked, "row_no", "left").select(
        "page_id", "url", "row_no", "ref_no", "ref_id", F.col("ref_no").isNull().alias("first"), base32(F.col("_hex")).alias("digest"), "html"
    )
    return written(flagged.mapInArrow(lambda it: _write(it, date), BUNDLE))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record, read through each bundle's seek table; payloads are checked against their digests."""
    tune(bundles.sparkSession)
    return bundles.select("content", "records").mapInArrow(_read, READ)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for b in batches:
        out = []
        for content, r in zip(b["content"], b["r"].to_pylist()):
            data = content.as_py()
            start, packed, _ = read_seek_table(data)[r["frame"]]
            plain = zstandard.ZstdDecompressor().decompress(data[start : start + packed])
            out.append((r["record_id"], plain[r["offset"] : r["offset"] + r["length"]]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["record_id", "record"])


def find_records(bundles: DataFrame, record_ids: list[str]) -> DataFrame:
    """(record_id, record bytes) of the records asked for; of each, one frame is decompressed."""
    tune(bundles.sparkSession)
    asked = bundles.sparkSession.createDataFrame([(x,) for x in record_ids], "record_id string")
    found = bundles.select("content", F.explode("records").alias("r")).join(F.broadcast(asked), F.col("r.record_id") == F.col("record_id"))
    return found.select("content", "r").mapInArrow(_look_up, "record_id string, record binary")
