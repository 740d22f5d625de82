"""WARC records in seekable Zstandard bundles.

A bundle is a row of frames that are compressed independently, each holding some whole records, and a skippable frame at the end
with the seek table (compressed and plain size of every frame). The index maps a record to bundle, frame, and the
offset inside the plain frame, so a single record costs one frame. Bundles are binary cells of a table in the shared folder: that is where
executors can write on any cluster; ``export_bundles`` writes them as files where a mounted folder exists.

Bundles are filled inside the tasks, in row order, so no page is moved for it. Equal payloads are found by digest: one row per
digest and map task is shuffled, and repeated digests are joined back.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import saved

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
MIN_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
SEEK_TABLE_FRAME, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null: empty), ``payload_digest`` and ``refers_to``.

    Of equal payloads of at least ``min_bytes`` bytes the largest page id is the response, the others refer to it. Rows that
    share that page id are all responses. A null id is smaller than any other.
    """
    rows = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    ).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("payload_digest")
    repeated = large.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept")).filter("n > 1").drop("n")
    joined = rows.join(saved(repeated, "repeated-payloads"), "payload_digest", "left")
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to")
    )


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit keeps the response's HTTP head, and with it the payload's length."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(plain: bytes, offset: int = 0) -> tuple[dict[str, object], int]:
    """The record that starts at ``offset`` and the offset of the next one."""
    head_end = plain.index(b"\r\n\r\n", offset)
    head = dict(line.split(": ", 1) for line in plain[offset:head_end].decode().split("\r\n")[1:])
    start, length = head_end + 4, int(head["Content-Length"])
    block = plain[start : start + length]
    http_end = block.index(b"\r\n\r\n")
    payload_bytes = int(re.search(rb"Content-Length: (\d+)", block[:http_end])[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda name: head[name][len("<urn:x-page:") : -1] or None
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[http_end + 4 :]
        if len(payload) != payload_bytes or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    record = {
        "page_id": page("WARC-Record-ID"), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"],
        "refers_to": page("WARC-Refers-To") if "WARC-Refers-To" in head else None,
        "payload": payload, "payload_bytes": payload_bytes, "payload_digest": digest,
    }
    return record, start + length + 4


class BundleWriter:
    """Fills frames and bundles; ``add`` and ``close`` return finished bundles with their index entries."""

    def __init__(self, prefix: str, frame_bytes: int, bundle_bytes: int) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.prefix, self.frame_bytes, self.bundle_bytes, self.number = prefix, frame_bytes, bundle_bytes, 0
        self._reset()

    def _reset(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str | None, int, int, int]] = []
        self.plain = bytearray()

    def _end_frame(self) -> None:
        if self.plain:
            self.frames.append(self.compress(bytes(self.plain)))
            self.sizes.append((len(self.frames[-1]), len(self.plain)))
            self.plain = bytearray()

    def add(self, page_id: str | None, record: bytes) -> list[tuple[str, bytes, list]]:
        self.index.append((page_id, len(self.frames), len(self.plain), len(record)))
        self.plain += record
        if len(self.plain) >= self.frame_bytes:
            self._end_frame()
            if sum(c for c, _ in self.sizes) >= self.bundle_bytes:
                return self.close()
        return []

    def close(self) -> list[tuple[str, bytes, list]]:
        self._end_frame()
        if not self.frames:
            return []
        table = b"".join(struct.pack("<II", *size) for size in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        data = b"".join(self.frames) + struct.pack("<II", SEEK_TABLE_FRAME, len(table)) + table
        done = [(f"{self.prefix}-{self.number:05d}", data, self.index)]
        self.number += 1
        self._reset()
        return done


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Place, compressed and plain size of every frame, read from the end of the bundle."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table, at, frames = bundle[len(bundle) - 9 - count * width :], 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_frame(bundle: bytes, frame: int) -> bytes:
    import zstandard

    at, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def write_bundles(
    records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Bundles (``bundle_id``, ``data``) and index (``page_id``, ``bundle_id``, ``frame``, ``offset``, ``length``) of ``record_types`` rows.

    Both are one table in the shared folder, written once. A record larger than a frame has a frame of its own size; no rows, no bundles.
    """
    kind = records.schema["page_id"].dataType.simpleString()
    names = ["bundle_id", "data", "page_id", "frame", "offset", "length"]
    types = [pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def rows(done: list[tuple[str, bytes, list]]) -> Iterator[pa.RecordBatch]:
        for name, data, index in done:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, data, None, None, None, None), types)], names)
            columns = [[name] * len(index), [None] * len(index), *map(list, zip(*index))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(f"{TaskContext.get().partitionId():06d}", frame_bytes, bundle_bytes)
        for part in parts:
            for i in range(len(part)):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in part.columns)
                yield from rows(writer.add(page_id, record_bytes(page_id, url, payload, digest, refers_to)))
        yield from rows(writer.close())

    source = records.select(
        F.col("page_id").cast("string"), "url", F.col("payload").cast("binary").alias("payload"), "payload_digest", F.col("refers_to").cast("string")
    )
    table = saved(source.mapInArrow(batches, "bundle_id string, data binary, page_id string, frame int, offset long, length long"), "bundles")
    bundles = table.filter(F.col("data").isNotNull()).select("bundle_id", "data")
    index = table.filter(F.col("data").isNull()).select(F.col("page_id").cast(kind).alias("page_id"), "bundle_id", "frame", "offset", "length")
    return bundles, index


RECORD_FIELDS = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
RECORD_SCHEMA = "page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def _records(found: list[dict[str, object]], fields: list[str]) -> pa.RecordBatch:
    types = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in found], types.get(f, pa.string())) for f in fields], fields)


def read_bundles(bundles: DataFrame, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """Every record of every bundle, frame by frame; a payload that does not match its digest is an error. A revisit has no payload."""
    fields = [f for f in RECORD_FIELDS if with_payload or f != "payload"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column(0):
                bundle = data.as_py()
                for frame in range(len(seek_table(bundle))):
                    plain, at, found = read_frame(bundle, frame), 0, []
                    while at < len(plain):
                        record, at = parse_record(plain, at)
                        found.append(record)
                    yield _records(found, fields)

    schema = ", ".join(s for s in RECORD_SCHEMA.split(", ") if with_payload or not s.startswith("payload binary"))
    records = bundles.select("data").mapInArrow(batches, schema)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def fetch(bundles: DataFrame, index: DataFrame, wanted: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of ``wanted`` (``page_id``), each from its own frame by the index."""
    places = wanted.select("page_id").distinct().join(index, "page_id").groupBy("bundle_id").agg(
        F.collect_list(F.struct("frame", "offset")).alias("places")  # at most the records of one bundle
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data, places in zip(part.column(0), part.column(1)):
                bundle, found = data.as_py(), []
                frames = {p["frame"]: read_frame(bundle, p["frame"]) for p in places.as_py()}
                found = [parse_record(frames[p["frame"]], p["offset"])[0] for p in places.as_py()]
                yield _records(found, RECORD_FIELDS)

    records = bundles.join(places, "bundle_id").select("data", "places").mapInArrow(batches, RECORD_SCHEMA)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def export_bundles(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as ``<bundle_id>.warc.zst`` into a folder that every executor has mounted."""

    def write(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row['bundle_id']}.{TaskContext.get().taskAttemptId()}")
            with open(part, "wb") as file:
                file.write(row["data"])
            os.replace(part, os.path.join(folder, f"{row['bundle_id']}.warc.zst"))

    bundles.foreachPartition(write)
