"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.functions.semantics import join_apart
from careline.llm.common import utf8, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed numbers of the seekable format: skippable frame, seek table, its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Layouts of the footer (frames, descriptor, magic) and of an entry (packed and plain bytes).
FOOTER, FOOTER_BYTES = "<IBI", 9
ENTRY, ENTRY_BYTES = "<II", 8
INDEX = "page_id long, bundle string, frame long, offset long, length long"
RECORD = ("page_id long, url string, record_type string, payload_digest string, "
          "payload_bytes long, refers_to long, payload binary")


def open_place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int,
                 refers_to: int | None, payload: bytes | None) -> bytes:
    """One record; `payload` of None makes it a revisit, which has no block."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
             f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}",
                                                   url))
    if payload is None:
        lines += [f"WARC-Refers-To: {name(refers_to)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        lines.append("Content-Type: text/html; charset=utf-8")
    body = payload or b""
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: memoryview, at: int) -> tuple[dict, int]:
    """The record at a place in a frame, and where the next one starts."""
    head_end = bytes(data[at:at + 65536]).find(b"\r\n\r\n")
    if head_end < 0:
        head_end = bytes(data[at:]).find(b"\r\n\r\n")
    lines = bytes(data[at:at + head_end]).decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = at + head_end + 4
    end = start + int(head["Content-Length"])
    number = lambda k: int(x) if (x := head.get(k, "")[10:-1]) else None
    response = head["WARC-Type"] == "response"
    payload = bytes(data[start:end]) if response else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {head['WARC-Record-ID']}: digest does not match the payload")
    url = head.get("WARC-Target-URI")
    return {"page_id": number("WARC-Record-ID"),
            "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
            "record_type": head["WARC-Type"], "payload_digest": digest,
            "payload_bytes": len(payload) if response else int(head["X-Payload-Length"]),
            "refers_to": number("WARC-Refers-To"), "payload": payload}, end + 4


class BundleWriter:
    """Appends records; a frame is closed when it holds `frame_bytes`."""

    def __init__(self, uri: str, frame_bytes: int, level: int) -> None:
        fs, path = open_place(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self._out, self._frame_bytes = fs.open_output_stream(path, compression=None), frame_bytes
        self._compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._frame, self._table, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, place in the frame, and length."""
        if len(self._frame) >= self._frame_bytes:
            self._close_frame()
        at = len(self._table), len(self._frame), len(record)
        self._frame += record
        return at

    def _close_frame(self) -> None:
        packed = self._compressor.compress(bytes(self._frame))
        self._out.write(packed)
        self._table.append((len(packed), len(self._frame)))
        self.written += len(packed)
        self._frame = bytearray()

    def close(self) -> None:
        if self._frame:
            self._close_frame()
        table = b"".join(struct.pack(ENTRY, *e) for e in self._table) + struct.pack(
            FOOTER, len(self._table), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._out.close()


class BundleReader:
    """Reads single frames by the seek table at the end of the bundle."""

    def __init__(self, uri: str) -> None:
        fs, path = open_place(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        self._file.seek(size - FOOTER_BYTES)
        n, descriptor, magic = struct.unpack(FOOTER, self._file.read(FOOTER_BYTES))
        if magic != SEEKABLE or descriptor:
            raise ValueError(f"{uri} has no seek table")
        self._file.seek(size - FOOTER_BYTES - n * ENTRY_BYTES)
        self._table, at = [], 0
        for packed, plain in struct.iter_unpack(ENTRY, self._file.read(n * ENTRY_BYTES)):
            self._table.append((at, packed, plain))
            at += packed

    def __len__(self) -> int:
        return len(self._table)

    def frame(self, k: int) -> memoryview:
        at, packed, plain = self._table[k]
        self._file.seek(at)
        return memoryview(zstandard.ZstdDecompressor().decompress(
            self._file.read(packed), max_output_size=plain))


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, size, refers_to); refers_to of NULL makes a response.

    Of equal payloads of at least `least_bytes`, rows with the smallest page_id are responses. First ids
    are found on digests and sizes alone, and only of payloads that repeat; the engine can split
    the rows of a payload that many pages share when they are joined to theirs.
    """
    payload = utf8(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("sha1"),
                        F.octet_length(payload).cast("long").alias("size"))
    firsts = (rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("k")).filter("k > 1").drop("k"))
    return join_apart(rows, firsts, ["sha1", "size"], "left").select(
        "page_id", "url", "payload", "sha1", "size",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
        .alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0,
                  frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26,
                  level: int = 3) -> DataFrame:
    """Writes `<folder>/*.warc.zst` and `<folder>/index`; returns the index as a table.

    Each task writes bundles of its own, under names never used before, and the index names only those
    of tasks that succeeded: a repeated task leaves an unnamed file, no double record. A frame
    holds about `frame_bytes` before compression (one record at least), a bundle about `bundle_bytes` after.
    A NULL html is an empty payload, a NULL url is left out, a NULL page_id an empty identifier;
    repeated rows are records of their own; no rows give no bundle. Other columns are ignored.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, uri = None, ""
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, size, refers = (
                    batch.column(c)[i].as_py() for c in range(6))
                if bundle is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(uri, frame_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                rows.append((page_id, uri, *bundle.add(record_bytes(
                    page_id, url, digest, size, refers, payload if refers is None else None))))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                        pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()),
                        strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    index = with_roles(pages, least_bytes).mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()), ("payload", pa.binary())]))


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the index's bundles, frame by frame, digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first, last in zip(*(batch.column(c).to_pylist() for c in range(3)),
                                        strict=True):
                reader = BundleReader(uri)
                for k in range(first, last + 1):
                    frame, at, records = reader.frame(k), 0, []
                    while at < len(frame):
                        record, at = parse_record(frame, at)
                        if not payloads:
                            record["payload"] = None
                        records.append(record)
                    yield _batch(records)

    # 64 frames to a share, so that a large bundle is read by several tasks. Shares are short rows, which
    # the engine would put together by their size; they are dealt out by number instead.
    shares = written(index.groupBy("bundle", F.floor(F.col("frame") / 64).alias("part"))
                     .agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
                     .select("bundle", "first", "last"), "shares")
    return _dealt(shares, ["bundle", "first"]).mapInArrow(run, RECORD)


def _dealt(places: DataFrame, order: list[str]) -> DataFrame:
    """Rows in as many partitions as there are rows, but no more than the session shuffles to."""
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartitionByRange(max(1, min(tasks, places.count())), *order)


def fetch(index: DataFrame) -> DataFrame:
    """The records of the given index rows only: one frame read for each frame they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, frame, offsets in zip(*(batch.column(c).to_pylist() for c in range(3)),
                                           strict=True):
                data = BundleReader(uri).frame(frame)
                yield _batch([parse_record(data, at)[0] for at in sorted(offsets)])

    places = written(index.groupBy("bundle", "frame")
                     .agg(F.collect_list("offset").alias("offsets")), "frames")
    return _dealt(places, ["bundle", "frame"]).mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back."""
    records = read_bundles(write_bundles(pages, folder, least_bytes), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type",
                          "refers_to")
