"""A collection of chunks with their vectors: stored once, read as the latest of each chunk.

Upserts and deletions are parts of a log of commits; a deleted id is a row that says so, a
deleted ticker an entry. Rows lie in BUCKETS folders by a hash of the chunk's id, so that a
lookup of some ids reads their buckets only. ``compact`` writes what still counts anew; a
collection of one such part is read without looking for later rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .commits import Log, parts_of, visible
from .store import ADDED, latest_by

BUCKETS = 16
TABLE = "chunks"
ROW = f"{schemas.CHUNK}, embedding array<float>, gone boolean"


class VectorCollection:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Log(spark, self.folder)

    @property
    def path(self) -> str:
        return f"{self.folder}/{TABLE}"

    def _bucket(self, key: str = "chunk_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def _add(self, rows: DataFrame, placed: bool = False, **entry) -> None:
        whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], ROW).schema]).withColumn("bucket", self._bucket())
        name = uuid.uuid4().hex
        (whole if placed else whole.repartition("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{ADDED}={name}")
        self.commits.commit({"add": name, "tables": [TABLE], "schema": 1, **entry})

    def _log(self) -> tuple[DataFrame, bool]:
        """All rows that no deleted ticker hides, and whether each id occurs once."""
        entries = self.commits.entries()
        parts, deleted = parts_of(entries, TABLE)
        if not parts:
            return self.spark.createDataFrame([], f"{ROW}, bucket int, place int"), True
        rows = self.spark.read.schema(f"{ROW}, {ADDED} string, bucket int").option("basePath", self.path).parquet(*[f"{self.path}/{ADDED}={n}" for n, *_ in parts])
        once = len(parts) == 1 and any(e.get("add") == parts[0][0] and "upto" in e for e in entries)
        return visible(rows, parts, deleted, ADDED).drop(ADDED), once

    def rows(self, ids: DataFrame | None = None, placed: bool = False) -> DataFrame:
        """The chunks that are there with their vectors; of ``ids`` (chunk_id) alone if given, from their buckets.

        What orders the rows of an id is a hash taken before they are shuffled, so that who asks for ids or counts moves no
        texts. ``placed`` deals the rows by bucket.
        """
        found, once = self._log()
        if ids is not None:
            asked = ids.select("chunk_id").distinct()
            buckets = [r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # BUCKETS numbers at most
            found = found.where(F.col("bucket").isin(buckets)).join(asked, "chunk_id", "left_semi")
        if placed:
            found = found.repartition("bucket")
        keys = ["bucket", "chunk_id"] if placed else ["chunk_id"]
        latest = found if once else latest_by(found.withColumn("__tie", F.xxhash64("text")), keys, F.desc("place"), F.col("__tie")).drop("__tie")
        return latest.where("not coalesce(gone, false)").drop("gone", "bucket", "place")

    def count(self) -> int:
        return self.rows().count()

    def upsert(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> int:
        """Embed and store those ``chunks`` that aren't there yet; how many there are in all then."""
        there = self.rows().select("chunk_id", F.lit(True).alias("__there"))
        both = chunks.withColumn("__there", F.lit(False)).unionByName(there, allowMissingColumns=True).withColumn("__bucket", self._bucket())
        # one shuffle, by bucket: what is embedded stays in its task and is written there
        fresh = latest_by(both.repartition("__bucket"), ["__bucket", "chunk_id"], F.desc("__there")).where("not __there").drop("__there", "__bucket")
        self._add(embed(fresh), placed=True)
        return self.count()

    def replace(self, rows: DataFrame) -> None:
        """Store ``rows``, vectors included, whether there are such chunks or not."""
        self._add(rows.dropDuplicates(["chunk_id"]))

    def delete(self, ids: DataFrame) -> None:
        """Take out the chunks of ``ids`` (chunk_id); unknown ones are no fault."""
        self._add(ids.select("chunk_id", F.lit(True).alias("gone")).distinct())

    def delete_ticker(self, ticker: str) -> None:
        self.commits.commit({"delete": ticker})

    def compact(self) -> None:
        """Write what counts as one part; what others add or delete meanwhile goes on counting."""
        upto = len(self.commits.entries()) - 1
        parts, _ = parts_of(self.commits.entries()[: upto + 1], TABLE)
        self._add(self.rows(placed=True), placed=True, upto=upto, stands_for=[p for p, *_ in parts])
