"""Signal store: append-only tables with a log of commits, read through a latest-wins view.

Plain parquet has no MERGE, so an upsert is an append and a later row of the same key
wins on reading. Tables are partitioned by fiscal year, which period filters prune.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT
from ..functions import periods, text
from .commits import Log, parts_of, visible

TABLES = {**{f"{k}_signals": schemas.table_schema(k) for k in schemas.SIGNALS}, "ingested_documents": schemas.DOCUMENT, "signal_runs": schemas.RUN, "signal_manifests": schemas.MANIFEST}
PERIOD = ("ticker", "quarter", "fiscal_year")
#: The partition column that names the commit which a row came with.
ADDED = "added"


def latest_by(df: DataFrame, keys, *order: Column) -> DataFrame:
    """One row a key: the first by ``order`` (end it with a unique column)."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def latest_wins(df: DataFrame, keys=PERIOD, stamp: str = "generated_at", tie: str = "id") -> DataFrame:
    return latest_by(df, keys, F.col(stamp).desc_nulls_last(), F.col(tie).desc_nulls_last())


def rekey(df: DataFrame, prefix: str) -> DataFrame:
    """Legacy repair: newest row a period, under its natural key. Applying it twice changes nothing."""
    return latest_wins(df).withColumn("id", text.natural_key(prefix, F.col("ticker"), F.col("quarter"), F.col("fiscal_year")))


def mismatched_keys(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(~F.col("id").eqNullSafe(text.natural_key(prefix, F.col("ticker"), F.col("quarter"), F.col("fiscal_year"))))


def history(df: DataFrame, columns, ticker: str | None = None, limit: int | None = 8) -> DataFrame:
    """Newest periods first; ``ticker`` is pushed to the scan."""
    found = df if ticker is None else df.where(F.col("ticker") == ticker)
    idx = periods.idx_of(F.col("quarter"), F.col("fiscal_year"))
    found = found.select(*columns).orderBy(idx.desc_nulls_last(), *[F.col(c) for c in ("id",) if c in columns])
    return found if limit is None else found.limit(limit)


def prune(stored: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored rows whose key is in ``keep``; an empty keep-set prunes nothing."""
    if keep.isEmpty():
        return stored
    return stored.join(keep.select(key).distinct(), key, "left_semi")


def new_rows(arrived: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Arrived rows whose key is not stored yet, one a key."""
    return arrived.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def corpus_fingerprint(docs: DataFrame, keys=PERIOD, model: str = "", version: str = "", profile: str = "") -> DataFrame:
    """sha256[:32] a period over its documents and chunk counts, the model, version and retrieval profile.

    The ordered join of a period's documents is bounded by the documents a period may have.
    """
    payload = F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "doc_id", F.col("n_chunks").cast("string")))))
    tail = F.lit(f"||{model}||{version}||{profile}")
    return docs.groupBy(*keys).agg(payload.alias("__payload")).withColumn("fingerprint", F.substring(F.sha2(F.concat("__payload", tail).cast("binary"), 256), 1, 32)).drop("__payload")


def reuse_gate(periods_df: DataFrame, runs: DataFrame, complete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(periods to reuse, periods to score): reuse needs an equal fingerprint and all four signals."""
    done = runs.select(*PERIOD, "fingerprint").join(complete.select(*PERIOD), list(PERIOD), "left_semi")
    keys = [*PERIOD, "fingerprint"]
    return periods_df.join(done, keys, "left_semi"), periods_df.join(done, keys, "left_anti")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; only a local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that what follows does not compute it again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_filesystem(uri: str):
    """(pyarrow file system, path) of a file in the shared folder, for tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        from urllib.parse import unquote

        return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class SignalStore:
    """Tables in a folder that driver and executors share, with one log of commits for all of them.

    A commit writes rows of one or more tables and then adds an entry to the log, so readers see all of it or nothing.
    Rows are never changed in place: a later row of a key wins, a deleted ticker hides what was committed before, and
    ``compact`` writes what is left anew. Writers don't wait for each other and lose nothing. Entries name the version of
    the schema that their rows were written with; ``upgrade`` says how older rows are read.
    """

    def __init__(self, spark: SparkSession, folder: str, config=DEFAULT):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.commits = Log(spark, self.folder)

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.folder}/{table}"

    def _declared(self, table: str, rows: DataFrame) -> DataFrame:
        declared = self.spark.createDataFrame([], TABLES[table])
        whole = declared.unionByName(rows, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in declared.schema])
        if table == "signal_manifests":  # a signal without a manifest leaves the stored one alone
            whole = whole.where("manifest is not null")
        if table == "ingested_documents":
            whole = whole.withColumn("raw_text", F.substring("raw_text", 1, self.config.doc_max_chars))
        return whole

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Store rows of several tables at once."""
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            self._declared(table, rows).write.partitionBy("fiscal_year").parquet(f"{self.path(table)}/{ADDED}={name}")
        return self.commits.commit({"add": name, "tables": list(tables), "schema": schemas.VERSION})

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.commit({table: rows})

    def _parts(self, table: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
        return parts_of(self.commits.entries(), table)

    def log(self, table: str) -> DataFrame:
        """All rows of a table that are not deleted, each with its ``place`` in the log."""
        parts, deleted = self._parts(table)
        empty = self.spark.createDataFrame([], f"{TABLES[table]}, place int")
        if not parts:
            return empty
        found = None
        for version in sorted({v for _, _, v in parts}):
            own = [name for name, _, v in parts if v == version]
            rows = self.spark.read.schema(f"{schemas.declared(table, version, TABLES[table])}, {ADDED} string").option("basePath", self.path(table)).parquet(*[f"{self.path(table)}/{ADDED}={n}" for n in own])
            rows = schemas.upgrade(table, version, rows)
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        found = visible(found, parts, deleted, ADDED)
        return empty.unionByName(found.drop(ADDED), allowMissingColumns=True).select(empty.columns)

    def rows(self, table: str) -> DataFrame:
        stamp = {"ingested_documents": "ingested_at", "signal_runs": "scored_at"}.get(table, "generated_at")
        order = [F.col(stamp).desc_nulls_last()]
        if table == "ingested_documents":
            return latest_by(self.log(table), ["doc_id"], *order, F.desc("place"), F.xxhash64("raw_text")).drop("place")
        keys = ["id"] if table in ("signal_runs", "signal_manifests") else PERIOD
        return latest_by(self.log(table), keys, *order, F.col("id").desc_nulls_last(), F.desc("place")).drop("place")

    def documents(self, ticker: str, quarter: str | None = None, fiscal_year: int | None = None, limit: int = 50) -> DataFrame:
        found = self.rows("ingested_documents").drop("raw_text").where(F.col("ticker") == ticker)
        if quarter is not None:
            found = found.where(F.col("quarter") == quarter)
        if fiscal_year is not None:
            found = found.where(F.col("fiscal_year") == fiscal_year)
        return found.orderBy(F.desc_nulls_last("fiscal_year"), F.desc_nulls_last("quarter"), F.desc_nulls_last("ingested_at"), "doc_id").limit(limit)

    def delete_ticker(self, ticker: str) -> None:
        """Hide what every table has of a ticker so far; rows that others commit meanwhile or later stay."""
        self.commits.commit({"delete": ticker})

    def compact(self, table: str) -> None:
        """Write the rows of a table that still count as one part. Commits and deletions since then go on counting."""
        upto = len(self.commits.entries()) - 1
        parts, _ = self._parts(table)
        if len(parts) < 2 and not self.commits.entries()[upto:]:
            return
        name = uuid.uuid4().hex
        self.rows(table).write.partitionBy("fiscal_year").parquet(f"{self.path(table)}/{ADDED}={name}")
        self.commits.commit({"add": name, "tables": [table], "schema": schemas.VERSION, "upto": upto, "stands_for": [p for p, *_ in parts]})

    def wipe(self, really: bool = False) -> list[str]:
        """Paths of all tables; they and the log are removed only if ``really``."""
        paths = [f"{self.folder}/{t}" for t in TABLES]
        if really:
            for name in [*TABLES, "_log"]:
                self.commits.folder.remove(name)
            self.commits = Log(self.spark, self.folder)
        return paths
