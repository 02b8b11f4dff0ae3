"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that decompress independently; a skippable frame at the
end of a bundle is the seek table of the public seekable format (compressed and
decompressed size of each frame); each record's address is (bundle, frame, offset within
the frame's plain bytes, length) under the record's own identifier. Executors write bundles to the shared folder under
names of their own attempt, so a repeated task never overwrites another's file, and only
the files that the returned index names are ever read.

Defined results: a null html is an empty payload; rows with a null id are records too;
among equal payloads all rows that bear the smallest id are responses (repeated rows
included) and the others are revisits; if every id of a payload is null, all of its rows
are responses. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise, open_filesystem, prepare

#: Fixed values of the seekable format: skippable-frame and seek-table magic numbers.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Frames read by a task, and neighbouring frames that stay together.
TASK_FRAMES, SLAB_FRAMES = 64, 8

INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame long, at long, length long"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def new_record_id() -> str:
    """An id of one record alone: rows may repeat, and an attempt that is run again writes records of its own."""
    return uuid.uuid4().urn


def build_record(page_id, url, payload: bytes, refers_to, digest: str, record_id: str | None = None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id or new_record_id()}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        payload = b""
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}"]).encode()
    return head + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    """One bundle: frames of whole records, then the seek table."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.plain, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        where = (len(self.frames), self.size, len(record))
        self.plain.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.flush()
        return where

    def flush(self) -> None:
        if self.plain:
            packed = self.pack.compress(b"".join(self.plain))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.plain, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame, from the footer alone."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * n)
    raw, out, at = file.read(8 * n), [], 0
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def _writer(folder: str):
    def write(batches):
        fs, base = open_filesystem(folder)
        bundle, rows, name = None, [], ""
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                record_id = new_record_id()
                record = build_record(page_id, url, payload, refers_to, payload_digest(payload), record_id)
                rows.append((record_id, page_id, name, *bundle.add(record)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if bundle is None and rows:  # an address is told only when its bundle is closed
                yield _index_batch(rows)
                rows = []
        if bundle is not None:
            bundle.close()
            yield _index_batch(rows)

    return write


def _index_batch(rows):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])


def _reader(folder: str):
    def read(batches):
        import pyarrow as pa
        import zstandard

        fs, base = open_filesystem(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            asked: dict[str, list] = {}
            for row in batch.to_pylist():
                asked.setdefault(row["bundle"], []).append(row)
            rows = []
            for name, frames in asked.items():
                with fs.open_input_file(f"{base}/{name}") as file:
                    table = seek_table(file)
                    for entry in sorted(frames, key=lambda e: e["frame"]):
                        at, packed, plain = table[entry["frame"]]
                        file.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                        for where in entry["records"]:
                            rows.append(_read_row(where["record_id"], *parse_record(data[where["at"]: where["at"] + where["length"]])))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return read


def _read_row(record_id: str, fields: dict[str, str], payload: bytes):
    if fields["WARC-Record-ID"] != f"<{record_id}>":
        raise ValueError("the index tells another record's address")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError("a payload read back differs from what was written")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return (int(page) if page else None, int(fields["X-Payload-Length"]), digest, kind, int(refers) if refers else None)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): which rows are stored and which revisit another."""
    base = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    first = base.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    joined = base.join(first, "digest", "left")
    refers = F.when(large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archive(records: DataFrame, folder: str) -> DataFrame:
    """Write bundles; return the index (record_id, page_id, bundle, frame, at, length), stored in the shared folder."""
    spark = records.sparkSession
    prepare(spark)
    fs, base = open_filesystem(folder)
    fs.create_dir(base, recursive=True)
    return materialise(records.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder), INDEX_SCHEMA), "warc-index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """Read every indexed record back; a task reads about TASK_FRAMES frames, in runs of a bundle's neighbours."""
    slab = F.floor(F.col("frame") / SLAB_FRAMES).alias("slab")
    tasks = max(1, -(-index.select("bundle", "frame").distinct().count() // TASK_FRAMES))
    dealt = index.select("record_id", "bundle", "frame", "at", "length", slab).repartition(tasks, "bundle", "slab")
    # a frame holds at most FRAME_BYTES beyond its last record, so these lists are bounded
    frames = dealt.groupBy("bundle", "slab", "frame").agg(F.collect_list(F.struct("record_id", "at", "length")).alias("records"))
    return frames.select("bundle", "frame", "records").mapInArrow(_reader(folder), READ_SCHEMA)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    index = write_archive(plan_records(pages, min_bytes), folder)
    return read_archive(index, folder)
