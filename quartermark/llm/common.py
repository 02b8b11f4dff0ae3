"""Shared helpers: session settings, shared-folder tables, words, storage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts may be long, so batches stay short.
BATCH_ROWS = 128
BATCH_BYTES = 1 << 24

#: The white space that separates words, as a Java/RE2/Python character class body.
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bound the size of Arrow batches, so that memory does not follow text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = found.get() if found.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        os.makedirs(configured, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/qm-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._qm_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete the tables that ``materialise`` wrote; for those that nothing reads any more."""
    for df in stored:
        path = getattr(df, "_qm_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__qm_{stem}", 0
    while name in taken:
        n += 1
        name = f"__qm_{stem}_{n}"
    return name


def remainder(doc_id, modulus: int):
    """crc32 of the decimal doc_id modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def words_of(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def words_of_bytes(text: bytes) -> list[bytes]:
    for c in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
        if c in text:
            text = text.replace(c, b" ")
    return [w for w in text.split(b" ") if w]


def open_filesystem(uri: str):
    """(pyarrow file system, path) of a folder that executors can reach."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
