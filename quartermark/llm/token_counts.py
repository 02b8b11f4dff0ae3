"""Token counts from flat token files by a separator scan.

Token files hold nothing but fixed-width ids, each document ended by the end-of-document
id. They are read in blocks of bytes; in each block the separators are found by one
vectorised comparison, and a prefix scan over a file's blocks (separators seen before a
block, position after the last of them) stitches the documents that cross blocks.

Defined results: an empty or null text is a document of no tokens; ids after a file's last
separator are a last, unended document; an empty file has no documents; repeated rows and
null ids are documents of their own; a document may span any number of blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode
from .common import fresh_path, materialise, open_filesystem, prepare

#: The id that ends a document; the rank file leaves it free.
END_OF_DOCUMENT = 50256
#: A file is closed once it is this long, and read in blocks of this many bytes.
FILE_BYTES = 1 << 25
BLOCK_BYTES = 1 << 22
DTYPE = "<u2"


def _write(folder: str, rank_path: str, end: int, dtype: str):
    def write(batches):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        sink, name, rows, size = None, "", [], 0

        def closed():
            sink.close()
            names = ["file", "ordinal", "doc_id", "bytes"]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([size] * len(rows), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.tokens"
                    sink, rows, size = fs.open_output_stream(f"{base}/{name}", compression=None), [], 0
                data = np.array([*encode(text, rank_path), end], dtype=dtype).tobytes()
                sink.write(data)
                rows.append((name, len(rows), doc_id))
                size += len(data)
                if size >= FILE_BYTES:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return write


def write_token_files(docs: DataFrame, folder: str, rank_path: str, doc_id: str = "doc_id", text: str = "text", end: int = END_OF_DOCUMENT, dtype: str = DTYPE) -> DataFrame:
    """Write flat token files; return (file, ordinal, doc_id, bytes): the order of documents in each file."""
    prepare(docs.sparkSession)
    fs, base = open_filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_write(folder, rank_path, end, dtype), "file string, ordinal long, doc_id long, bytes long")
    return materialise(rows, "token-order")


def scan_block(ids: np.ndarray, end: int) -> tuple[int, int, np.ndarray]:
    """(ids before the first separator, ids after the last one, lengths between separators)."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return len(ids), len(ids), at
    return int(at[0]), int(len(ids) - 1 - at[-1]), np.diff(at) - 1


def _scan(folder: str, end: int, dtype: str):
    def scan(batches):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['file']}") as file:
                    file.seek(row["start"])
                    ids = np.frombuffer(file.read(row["size"]), dtype=dtype)
                head, tail, inner = scan_block(ids, end)
                found = len(inner) + 1 if head < len(ids) or not len(ids) else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["start"] // width]), pa.array([len(ids)]), pa.array([found]), pa.array([head]), pa.array([tail]), pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))],
                    names=["file", "start", "n", "found", "head", "tail", "inner"])

    return scan


def scan_token_files(spark: SparkSession, files: DataFrame, folder: str, end: int = END_OF_DOCUMENT, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the files (file, bytes)."""
    prepare(spark)
    width = np.dtype(dtype).itemsize
    block = max(width, block_bytes // width * width)
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block).cast("long"))).alias("start"))
    blocks = blocks.select("file", "start", F.least(F.lit(block), F.col("bytes") - F.col("start")).alias("size"))
    parts = blocks.repartition(F.col("file"), F.col("start")).mapInArrow(_scan(folder, end, dtype), "file string, start long, n long, found long, head long, tail long, inner array<long>")
    # the prefix scan: a file has FILE_BYTES / BLOCK_BYTES blocks, so its windows are short
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    after_last = F.when(F.col("found") > 0, F.col("start") + F.col("n") - F.col("tail"))
    placed = parts.select(
        "file", "start", "n", "found", "head", "tail", "inner",
        F.coalesce(F.sum("found").over(before), F.lit(0)).alias("base"),
        (F.col("start") - F.coalesce(F.max(after_last).over(before), F.lit(0))).alias("carried"),
        F.max("start").over(whole).alias("last"),
    )
    lengths = F.concat(
        F.when(F.col("found") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>")),
        F.when((F.col("start") == F.col("last")) & (F.col("found") > 0) & (F.col("tail") > 0), F.array("tail"))
        .when((F.col("start") == F.col("last")) & (F.col("found") == 0), F.array(F.col("carried") + F.col("n")))
        .otherwise(F.array().cast("array<long>")),
    )
    return placed.select("file", "base", F.posexplode(lengths)).select("file", (F.col("base") + F.col("pos")).alias("ordinal"), F.col("col").alias("n_tokens"))


def count_tokens(docs: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, counted in its flat token file."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    order = write_token_files(docs, folder, rank_path)
    files = order.groupBy("file").agg(F.max("bytes").alias("bytes"))
    counts = scan_token_files(spark, files, folder)
    # both sides have a row a document; stored, they are small enough for Spark to broadcast one, in memory they aren't
    return order.select("file", "ordinal", "doc_id").hint("merge").join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
