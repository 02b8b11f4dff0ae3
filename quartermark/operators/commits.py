"""A log of commits in a shared folder: numbered entries, each of which appears whole and once.

Writers first write their data under names of their own and then add the next entry. Only
one writer can create an entry of a number; another finds it taken and adds the one after.
Readers take all entries up to the first number that is free.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """The few file operations that a log needs, by Hadoop's file systems or, for local paths, the operating system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file could be made; False if there is one of that name."""
        if self.local:  # a link gives the name to a file that is whole already, or fails
            place = self._at(name).toUri().getPath()
            os.makedirs(os.path.dirname(place), exist_ok=True)
            part = f"{place}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as file:
                file.write(text)
            try:
                os.link(part, place)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(part)
        if self.fs.exists(self._at(name)):
            return False
        try:
            stream = self.fs.create(self._at(name), False)
        except Exception as e:  # py4j wraps what the file system says
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True


class Log:
    """Entries (dicts) in ``folder``/_log, numbered from 0."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = Folder(spark, folder)
        self._read: list[dict] = []  # entries never change

    @staticmethod
    def _name(n: int) -> str:
        return f"_log/{n:012d}.json"

    def entries(self) -> list[dict]:
        there = {n for n in self.folder.names("_log") if n.endswith(".json")}
        while self._name(len(self._read)).removeprefix("_log/") in there:
            self._read.append(json.loads(self.folder.read(self._name(len(self._read)))))
        return list(self._read)

    def commit(self, entry: dict, attempts: int = 1000) -> int:
        """Add ``entry`` after all others; its number."""
        n = len(self.entries())
        for at in range(n, n + attempts):
            if self.folder.create(self._name(at), json.dumps(entry)):
                return at
        raise RuntimeError(f"{attempts} other writers came first")


def parts_of(entries: list[dict], table: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
    """(part, place, schema version) of what a table consists of, and (ticker, place) of what is deleted; later places win."""
    parts, deleted = [], []
    for at, entry in enumerate(entries):
        if "delete" in entry:
            deleted.append((entry["delete"], at))
        elif table in entry["tables"]:
            if "upto" in entry:  # a compaction stands for its parts as they were when it read them
                parts = [p for p in parts if p[0] not in entry["stands_for"]]
            parts.append((entry["add"], entry.get("upto", at), entry["schema"]))
    return sorted(parts, key=lambda p: p[1]), deleted


def visible(rows: DataFrame, parts, deleted, added: str) -> DataFrame:
    """``rows`` with the ``place`` of the commit that they came with, less those of tickers that were deleted later."""
    places = F.create_map(*[F.lit(x) for name, at, _ in parts for x in (name, at)])
    rows = rows.withColumn("place", places[F.col(added)])
    for ticker, at in deleted:
        rows = rows.where(~(F.col("ticker").eqNullSafe(F.lit(ticker)) & (F.col("place") < at)))
    return rows
