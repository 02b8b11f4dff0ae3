"""Near copies by the shingles of five words that texts share: exact Jaccard >= LEAST.

The method is SimHash: texts have fingerprints of their five-word shingles, and Golay-code keys
(``simhash.links``) bring together those that differ in two bits at most. The texts of each
group of fingerprints are verified by their whole sets of shingles. A pair at LEAST differs in
about 10 of 64 bits, though, more than Golay segments can bring together, so what lies beyond
two bits comes from BANDS bands of ROWS_A_BAND MinHash values, among texts that SimHash has not
connected yet: a pair at 0.8 shares no band once in six million, more alike pairs less often yet.
Texts with one set of shingles are one node, named by a 64-bit hash of it. Texts without words
are alike.

Members of a bucket, be it a group of fingerprints or a band's, are first verified with one
of them: the same for all buckets that hold it, so that copies which share many buckets meet
once. Buckets that this connects are done. In the others all but the members of the largest
group meet all members, in parts of about CROWD by a hash, so that no task gets a group that
grows with the data and no link is lost; those connected already are not compared again.

Texts that share a passage crowd buckets without being copies. So where more than CROWD members
are outside a bucket's largest group, its members are keyed anew, without loss: of two texts at
LEAST or more, each holds a shingle of the other among the 1 - LEAST of its own that come first
in any one order; in the order by how many of these texts hold a shingle, rarest first, what
many share comes last. The new buckets are treated as those before, after some rounds in which
their groups meet by their least members.

Texts that share a key, and the rows that stay, are fetched where they lie: the numbers of the
rows asked for go to the part files that hold them, a list a file, and no other text is moved.
Rows with columns of types that may not come back from a file just as Spark wrote them (nested
ones, times) are joined instead.

Defined results: rows with a null id lose against all others of their group; repeated rows
are one group; of equal least ids one row stays; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from . import simhash
from .common import BATCH_ROWS, discard, free_name, materialise, open_filesystem, prepare
from .components import connected_components
from .simhash import hashes

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS_A_BAND = 30, 4
#: Members of a bucket that are verified in one task, about.
CROWD = 128
#: Times that groups of a bucket of rarest shingles meet by their least members before all members do.
ROUNDS = 4
EDGES = "a long, b long"
#: Tasks that fetch texts from part files, at most; bits of a row's number within its part.
FETCHERS, ROW_BITS = 20_000, 33
#: Types that a part file gives back as Spark wrote them.
PLAIN = (BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType)
_G = np.random.default_rng(42)
FACTORS = _G.integers(0, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _G.integers(0, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    return np.unique(hashes(text, SHINGLE))


def signature(text: str | None) -> np.ndarray:
    """The node of a text, its fingerprint as a 64-bit number, then its key in each band."""
    from xxhash import xxh64_intdigest

    found = hashes(text, SHINGLE)
    fp = simhash.majority(found) % (1 << 64)
    found = np.unique(found)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1 << 12):
        least = np.minimum(least, (found[at: at + (1 << 12), None] * FACTORS + SHIFTS).min(axis=0))
    bands = [xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS_A_BAND))]
    return np.array([xxh64_intdigest(found.tobytes()), fp, *bands], dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def _edges(sets: dict[int, np.ndarray], known: dict[int, int]) -> list[tuple[int, int]]:
    """Edges that connect what the similar pairs of ``sets`` connect; nodes of one ``known`` group are connected already."""
    parent: dict[int, int] = {}
    groups: dict[int, list[int]] = {}
    edges = []

    def root(name):
        while name in parent:
            name = parent[name]
        return name

    for node in sorted(sets):
        own = root(known.get(node, node))
        joined = groups.pop(own, [])
        for name in list(groups):
            hit = next((x for x in groups[name] if alike(sets[x], sets[node])), None)
            if hit is not None:
                edges.append((hit, node))
                parent[name] = own
                joined = groups.pop(name) + joined
        groups[own] = [*joined, node]
    return edges


def _verify(rows):
    import pyarrow as pa

    nodes = rows.column("node").to_pylist()
    sets = dict(zip(nodes, map(shingles, rows.column("text").to_pylist()), strict=True))
    known = dict(zip(nodes, rows.column("known").to_pylist(), strict=True)) if "known" in rows.column_names else {}
    edges = _edges(sets, known)
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _settled(places: DataFrame, nodes: DataFrame, *by: str) -> DataFrame:
    return places.join(nodes.select("node", "text"), "node").groupBy(*by).applyInArrow(_verify, EDGES)


def _parts(members, *salt):
    """A part of about CROWD of so many ``members``, by a hash of the node."""
    return F.pmod(F.xxhash64("node", *salt), F.greatest(F.ceil(members / CROWD), F.lit(1))).cast("int")


def _each(members):
    """A row for each part of so many ``members``."""
    return F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(members / CROWD), F.lit(1)).cast("int") - 1))


def _met(heads: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Edges of the ``heads`` (bucket, node) to the one of their bucket that comes first in an order of this turn.

    A pair that meets in several buckets is verified once, one of a ``known`` group not at all; a first one's
    visitors come in parts.
    """
    first = heads.groupBy("bucket").agg(F.min_by(F.struct("node", "known"), F.xxhash64("node", F.lit(turn))).alias("hub"))
    apart = heads.join(first, "bucket").where("known <> hub.known").select(F.col("hub.node").alias("hub"), "node")
    pairs = materialise(apart.distinct(), "copies-pairs")
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    visitors = pairs.join(sizes, "hub").select("hub", "node", _parts(F.col("n"), F.lit(turn)).alias("part"))
    hubs = sizes.select("hub", F.col("hub").alias("node"), _each(F.col("n")).alias("part"))
    return materialise(_settled(visitors.union(hubs), nodes, "hub", "part"), "copies-met")


def _open(places: DataFrame, edges: DataFrame) -> DataFrame:
    """The members (bucket, node, known, n, largest, others) of buckets that the ``edges`` don't connect yet.

    ``known`` is a node's group, ``largest`` that of most of the n members, ``others`` the number outside it.
    """
    groups = connected_components(edges, "copies-cc").select("node", "component")
    known = materialise(places.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("known")), "copies-known")
    sizes = known.groupBy("bucket", "known").agg(F.count("*").alias("n"))
    largest = F.max_by("known", F.struct("n", "known")).alias("largest")
    apart = sizes.groupBy("bucket").agg(largest, F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    return materialise(known.join(apart, "bucket"), "copies-open")


def _rest(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the open members ``left``: all but a bucket's largest group visit every part of it, in parts of their own."""
    row = ["bucket", "node", "known"]
    guests = left.where("known <> largest").select(*row, _parts(F.col("others"), F.lit(ROUNDS)).alias("guest"), _each(F.col("n")).alias("part"))
    hosts = left.select(*row, _each(F.col("others")).alias("guest"), _parts(F.col("n")).alias("part"))
    return materialise(_settled(guests.union(hosts).distinct(), nodes, "bucket", "guest", "part"), "copies-rest")


def _places(keyed: DataFrame, label: str) -> DataFrame:
    """(bucket, node, n) of the keys (node, key) that several nodes have; buckets of the same members are one."""
    h = F.xxhash64("node")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")).where("n > 1")
    once = sizes.groupBy("n", "low", "high").agg(F.min("key").alias("key"))
    return materialise(keyed.join(once.select("key", "n"), "key").select(F.col("key").alias("bucket"), "node", "n"), label)


def _shingle_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = shingles(text).view(np.int64)
            for at in range(0, len(found), 1 << 16):
                part = found[at: at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(part), pa.array(np.full(len(part), len(found)))], names=["node", "key", "size"])


def _rarest(nodes: DataFrame) -> DataFrame:
    """(node, key): the shingles that a text's copies share at least one of, by how few of the ``nodes`` hold them."""
    rows = materialise(nodes.select("node", "text").mapInArrow(_shingle_rows, "node long, key long, size long"), "copies-shingles")
    held = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")  # one that a text has alone finds nothing, but takes its place
    order = Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(1)), "key")
    first = rows.join(held, "key", "left").withColumn("place", F.row_number().over(order))
    return first.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(LEAST) - 1e-9) + 1) & F.col("held").isNotNull()).select("node", "key")


def _fetcher(row: str, columns: list[str], schema):
    """The rows that each part file is asked for: their nodes, then ``columns``, as ``schema`` has them."""

    def fetch(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for name, asked in zip(batch.column("file").to_pylist(), batch.column("asked"), strict=True):
                rows, nodes = (asked.values.field(k).to_numpy() for k in ("row", "node"))
                order = np.argsort(rows)
                rows, nodes = rows[order], nodes[order]
                fs, path = open_filesystem(name)
                with fs.open_input_file(path) as file:
                    for part in pq.ParquetFile(file).iter_batches(BATCH_ROWS, columns=[row, *columns]):
                        held = part.column(row).to_numpy()
                        at = np.minimum(np.searchsorted(rows, held), len(rows) - 1)
                        found = np.flatnonzero(rows[at] == held)
                        if len(found):
                            taken = [pa.array(nodes[at[found]]), *(part.column(c).take(pa.array(found)) for c in columns)]
                            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(taken, schema, strict=True)], schema=schema)

    return fetch


def _fetched(stored: DataFrame, asked: DataFrame, row: str, columns: list[str], node: str = "node") -> DataFrame:
    """(``node``, ``columns``) for the rows (node, row) ``asked`` of a table that was written with its rows' numbers.

    Only numbers are shuffled, to one row a part file, whose list is no longer than the file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name.lower(): f for f in stored.schema}
    fields = [kinds[c.lower()] for c in columns]
    out = StructType([StructField(node, LongType()), *(StructField(f.name, f.dataType) for f in fields)])
    part = F.shiftright(row, ROW_BITS).alias("part")
    files = stored.groupBy(part, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    lists = asked.groupBy(part).agg(F.collect_list(F.struct(F.col(row).alias("row"), "node")).alias("asked"))
    todo = materialise(lists.join(files, "part").select("part", "file", "asked"), "copies-asked")
    tasks = max(1, min(todo.count(), FETCHERS))
    fetch = _fetcher(row, [f.name for f in fields], to_arrow_schema(out))
    return todo.repartitionByRange(tasks, "part", "file").select("file", "asked").mapInArrow(fetch, out)


def _print_places(prints: DataFrame) -> DataFrame:
    """(bucket, node, n): the nodes (node, fp) of each group of fingerprints that Golay-code keys connect."""
    distinct = materialise(prints.select("fp").distinct(), "copies-prints")
    groups = simhash.groups(distinct).select(F.col("node").alias("fp"), "component")
    named = prints.join(groups, "fp", "left").select("node", F.coalesce("component", "fp").alias("group"))
    found = _places(named.select("node", F.xxhash64("group", F.lit("fingerprints")).alias("key")), "copies-printed")
    discard(distinct)
    return found


def links(marked: DataFrame, texts) -> DataFrame:
    """Edges (a, b) that connect every two of the distinct nodes of ``marked`` (node, fp, bands) that are similar.

    Groups of fingerprints come first; the bands' buckets then bring together what these leave apart.
    ``texts`` gives (node, text) for a table of nodes; it is asked once, for those that share a key.
    """
    printed = _print_places(marked.select("node", "fp"))
    keyed = marked.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    places = _places(keyed, "copies-places")
    nodes = materialise(texts(printed.union(places).select("node").distinct()), "copies-texts")
    edges = _met(printed.withColumn("known", F.col("node")), nodes, 0)
    left = _open(printed.where("n > 2").select("bucket", "node").union(places.select("bucket", "node")), edges)  # two of a group have met
    edges = materialise(edges.union(_met(left, nodes, 1)), "copies-edges")
    left = _open(left.where("n > 2").select("bucket", "node"), edges)  # two of a band have met
    few, many = left.where(F.col("others") <= CROWD), left.where(F.col("others") > CROWD)
    edges = materialise(edges.union(_rest(few, nodes)), "copies-edges")
    if many.isEmpty():
        return edges
    crowd = materialise(nodes.join(many.select("node").distinct(), "node", "left_semi").select("node", "text"), "copies-crowd")
    places = _places(_rarest(crowd), "copies-rare")
    left = _open(places, edges)
    for turn in range(ROUNDS):  # groups meet by their least members, another of which is a bucket's first each time
        more = _met(left.groupBy("bucket", "known").agg(F.min("node").alias("node")), crowd, turn)
        if more.isEmpty():
            break
        edges = materialise(edges.union(more), "copies-edges")
        left = _open(left.select("bucket", "node"), edges)
    return edges.union(_rest(left, crowd))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that with the least id, nulls last."""
    prepare(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(t) for t in texts], dtype=object)

    sig, row = free_name(docs, "signature"), free_name(docs, "row")
    marked = materialise(docs.withColumn(sig, signed(F.col(text))).withColumn(row, F.monotonically_increasing_id()), "copies-rows")
    node = F.get(F.col(sig), F.lit(0))
    order = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    distinct = materialise(marked.groupBy(node.alias("node")).agg(F.min(order).alias("least")), "copies-distinct")
    chosen = distinct.select("node", F.col("least.row").alias(row))
    once = marked.select(row, F.get(F.col(sig), F.lit(1)).alias("fp"), F.slice(sig, 3, BANDS).alias("bands")).join(chosen, row).select("node", "fp", "bands")

    def texts(nodes: DataFrame) -> DataFrame:
        return _fetched(marked, chosen.join(nodes, "node", "left_semi"), row, [text]).select("node", F.col(text).alias("text"))

    groups = connected_components(links(once, texts), "copies-cc")
    named = distinct.join(groups.select("node", "component"), "node", "left")
    winners = named.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    winners = materialise(winners.select("component", F.col("least.row").alias(row)), "copies-winners")
    discard(distinct)
    if all(isinstance(f.dataType, PLAIN) and "." not in f.name for f in docs.schema):
        return _fetched(marked, winners.withColumnRenamed("component", "node"), row, docs.columns, sig).select(*docs.columns)
    return marked.join(winners, row, "left_semi").drop(sig, row)
