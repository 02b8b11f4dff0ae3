"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small parquet files that never change. Shards fall into tiers by
their stored size (a tier spans a factor of GROWTH); a run of MIN_RUN or more shards of one
tier is merged, and merging goes on in plan until no tier has such a run, so that one
compaction rewrites each row at most once. Merged runs are cut into files of the target
size. A manifest names the shards of a version; it is written under a passing name and
renamed to its version, which fails if another writer has taken that version, so readers
see a whole version or none. Compaction deletes nothing: a version can be read until
``expire`` drops it by number, which removes the files that no later version names. Rows
move by DataFrame operations alone; only names and sizes of files (metadata, some hundred
bytes a shard, as Spark's own file index holds) reach the driver.

Defined results: an empty arrival adds a version without shards, and reading such a
version gives no rows of the arrival's columns; a shard larger than the target stays as it
is; rows are kept as they are, nulls, repeats and all columns included.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, fresh_path

TARGET_BYTES = 1 << 25
SMALL_BYTES = 1 << 16
GROWTH = 4
MIN_RUN = 4
CODEC = "zstd"
#: A manifest has a line a shard and one with the columns of its rows.
MANIFEST = "path string, rows long, bytes long, tier int, schema string"
#: Plans of at most this many shards are broadcast.
BROADCAST_SHARDS = 10_000


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int


def tier_of(size: int) -> int:
    return 0 if size <= SMALL_BYTES else 1 + int(math.log(size / SMALL_BYTES, GROWTH))


def plan_runs(shards: list[Shard], target: int = TARGET_BYTES, min_run: int = MIN_RUN) -> list[list[Shard]]:
    """Runs of shards to merge; no shard is in two runs, and no run is planned from large shards alone."""
    tiers: dict[int, list] = {}
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if s.bytes < target:
            tiers.setdefault(tier_of(s.bytes), []).append(([s], s.bytes))
    done = []
    while tiers:  # a merged run stays in its tier or goes up, so one ascent settles all
        tier = min(tiers)
        held = tiers.pop(tier)
        if len(held) < min_run:
            done += held
            continue
        merged, size = [], 0
        for run, n in held:
            merged, size = merged + run, size + n
            if size >= target:
                done.append((merged, size))
                merged, size = [], 0
        if merged:
            tiers.setdefault(tier_of(size), []).append((merged, size))
    return [run for run, _ in done if len(run) > 1]


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str | None = None, target: int = TARGET_BYTES, min_run: int = MIN_RUN):
        self.spark, self.folder = spark, folder or fresh_path(spark, "shards")
        self.target, self.min_run = target, min_run
        self._hadoop = spark._jvm.org.apache.hadoop
        self._path = self._hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._context = self._hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), conf)
        self._fs = self._path(self.folder).getFileSystem(conf)

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(text.encode())
        out.close()

    def version(self) -> int:
        folder = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest/v{version:08d}.json")

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        return [Shard(r["path"], r["rows"], r["bytes"], r["tier"]) for r in self._manifest(version).where("path is not null").collect()]

    def schema(self, version: int | None = None) -> StructType | None:
        """The columns of a version's rows; none if nothing told them yet."""
        version = self.version() if version is None else version
        told = self._manifest(version).where("schema is not null").select("schema").first() if version else None
        return StructType.fromJson(json.loads(told[0])) if told else None

    def commit(self, shards: list[Shard], based_on: int, schema: StructType | None = None) -> int:
        """Publish ``shards`` as the version after ``based_on``; fails if that version exists."""
        passing = f"{self.folder}/manifest/_{uuid.uuid4().hex}"
        head = json.dumps({"schema": schema.json()}) + "\n" if schema is not None else ""
        self._put(passing, head + "".join(json.dumps(asdict(s)) + "\n" for s in sorted(shards, key=lambda s: s.path)))
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        self._context.rename(self._path(passing), self._path(f"{self.folder}/manifest/v{based_on + 1:08d}.json"), options)
        return based_on + 1

    def _written(self, path: str) -> list[Shard]:
        if not any(s.getPath().getName().endswith(".parquet") for s in self._listed(path)):
            return []
        files = self.spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return [Shard(r["path"], r["rows"], r["bytes"], tier_of(r["bytes"])) for r in files.collect()]

    def _listed(self, path: str):
        found, it = [], self._fs.listFiles(self._path(path), True)
        while it.hasNext():
            found.append(it.next())
        return found

    def append(self, arrival: DataFrame) -> int:
        base = self.version()
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", CODEC).parquet(path)
        return self.commit(self.shards(base) + self._written(path), base, arrival.schema)

    def append_each(self, rows: DataFrame, arrival: Column, arrivals: int) -> int:
        """Append ``rows`` as arrivals 0 to ``arrivals`` - 1, a version each, in one pass over them."""
        base, name = self.version(), free_name(rows, "arrival")
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.withColumn(name, arrival).write.option("compression", CODEC).partitionBy(name).parquet(path)
        found = self._written(path)
        held = self.shards(base)
        for i in range(arrivals):
            held = held + [s for s in found if f"/{name}={i}/" in s.path]
            base = self.commit(held, base, rows.schema)
        return base

    def compact(self) -> int:
        """Merge the runs of the current version into a new one; older versions stay as they are."""
        base = self.version()
        shards = self.shards(base)
        runs = plan_runs(shards, self.target, self.min_run)
        if not runs:
            return base
        columns = self.schema(base)
        reader = self.spark.read if columns is None else self.spark.read.schema(columns)
        old = reader.parquet(*[s.path for run in runs for s in run])
        first, files = free_name(old, "first"), free_name(old, "files")
        rows, slots = [], 0
        for run in runs:
            cut = max(1, round(sum(s.bytes for s in run) / self.target))
            rows += [{"path": s.path, first: slots, files: cut} for s in run]
            slots += cut
        plan_path = f"{self.folder}/plans/{uuid.uuid4().hex}.json"
        self._put(plan_path, "".join(json.dumps(r) + "\n" for r in rows))
        plan = self.spark.read.schema(f"path string, {first} int, {files} int").json(plan_path)
        if len(rows) <= BROADCAST_SHARDS:
            plan = F.broadcast(plan)
        slot, at = free_name(old, "slot"), free_name(old, "path")
        moved = old.withColumn(at, F.col("_metadata.file_path")).join(plan.withColumnRenamed("path", at), at)
        moved = moved.withColumn(slot, F.col(first) + F.pmod(F.xxhash64(*old.columns), F.col(files))).drop(first, files, at)
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        moved.hint("rebalance", F.col(slot)).write.option("compression", CODEC).partitionBy(slot).parquet(path)
        merged = self._written(path)
        replaced = {s.path for run in runs for s in run}
        return self.commit([s for s in shards if s.path not in replaced] + merged, base, self.schema(base))

    def expire(self, keep: int) -> int:
        """Drop all but the last ``keep`` versions and the files that only they name; returns how many files went."""
        last = self.version()
        kept = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        gone = [v for v in range(1, last - keep + 1) if self._fs.exists(self._path(f"{self.folder}/manifest/v{v:08d}.json"))]
        stale = {s.path for v in gone for s in self.shards(v)} - kept
        for v in gone:  # first the names, so that no reader finds a version without its files
            self._fs.delete(self._path(f"{self.folder}/manifest/v{v:08d}.json"), False)
        for s in stale:
            self._fs.delete(self._path(s), False)
        return len(stale)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each with a struct column (file, rows, bytes, tier) of its shard; ``file`` is its path within the data folder."""
        version = self.version() if version is None else version
        shards = self.shards(version)
        columns = self.schema(version)
        if not shards and columns is None:
            raise ValueError(f"version {version} has neither shards nor columns")
        reader = self.spark.read if columns is None else self.spark.read.schema(columns)
        rows = reader.parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], columns)
        if not shards:
            return rows.withColumn(free_name(rows, "shard"), F.lit(None).cast("struct<file:string,rows:bigint,bytes:bigint,tier:int>"))
        at, shard = free_name(rows, "path"), free_name(rows, "shard")
        listed = self._manifest(version).where("path is not null").select(F.col("path").alias(at), F.struct(F.substring_index("path", "/data/", -1).alias("file"), "rows", "bytes", "tier").alias(shard))
        if len(shards) <= BROADCAST_SHARDS:
            listed = F.broadcast(listed)
        return rows.withColumn(at, F.col("_metadata.file_path")).join(listed, at).drop(at)


def compact_arrivals(docs: DataFrame, key: str = "doc_id", arrivals: int = 4, target: int = TARGET_BYTES) -> ShardStore:
    """Append ``docs`` as successive arrivals (dealt by a hash of the key) and compact them."""
    store = ShardStore(docs.sparkSession, target=target)
    store.append_each(docs, F.pmod(F.xxhash64(key), F.lit(arrivals)).cast("int"), arrivals)
    store.compact()
    return store
