"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to length one in double precision (by their largest component first, so
that no square under- or overflows) and quantised to int8 with one scale each; the length of
what quantisation loses is kept per vector. For unit vectors x = x' + d and y = y' + e the
product x·y differs from x'·y' by at most |d| + (1 + |d|) |e|, so a pair whose quantised
product plus that bound stays under the threshold can't link. The others are computed again
in double precision, and only that decides.

Equal vectors are one node with a multiplicity. Nodes are put beside the nearest of some
pivots and cut into tiles of about TILE; each tile is written once, as a file of codes and
bounds and a file of full vectors. A task takes one tile and a strip of others: it skips the
tiles whose centre lies further off than both radii and the threshold's angle allow (exact,
by the triangle inequality of angles), reads the codes of the rest, and full vectors only
where a pair is left open. It returns a link count a vector and a spanning forest of the
links, never the pairs. So a vector is shuffled once, however many tiles there are; reads
and products are quadratic in the number of distinct vectors where no tile can be skipped.

Defined results: null, zero or non-finite vectors, or vectors with a null component, link
with nothing; vectors of different lengths never link; repeated rows of one id are vectors
of their own; a null id names no component unless there is no other.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialise, open_filesystem, prepare
from .components import connected_components

THRESHOLD = 0.95
TILE_MIN, TILE = 128, 4096
TILES_ASKED = 16
#: Vectors that tiles are gathered around, at most, and those that each of them is chosen from.
PIVOTS = 256
#: Tiles of a strip, on the average.
STRIP = 8
BLOCK = 256
#: Slack of angles and radii for rounding.
SLACK = 1e-6
OUT_SCHEMA = "gid long, links long, other long"
TILE_SCHEMA = "width int, name string, center array<double>, radius double"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their magnitude."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, bounds on the length of the loss) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    loss = np.linalg.norm(unit - codes * scale[:, None], axis=1) * (1 + 1e-12) + 1e-12
    return codes, scale, loss


def open_pairs(x, y, alone: bool, threshold: float = THRESHOLD):
    """Pairs (i, j) of rows of ``x`` and ``y`` (both (codes, scales, losses)) that may link, in blocks; ``alone``: i < j only."""
    (cx, sx, ex), (cy, sy, ey) = x, y
    # sums of products of int8 codes are whole numbers under 2**24, exact in float32, for up to 1040 components
    fine = np.float32 if cx.shape[1] <= 1040 else np.float64
    right = cy.astype(fine).T.copy()
    for at in range(0, len(cx), BLOCK):
        end = min(at + BLOCK, len(cx))
        product = cx[at:end].astype(fine) @ right
        # the least product with which a row may link with any column
        least = (threshold - ex[at:end] - (1 + ex[at:end]) * ey.max() - 1e-9) / (sx[at:end] * sy.max())
        rows = np.flatnonzero(product.max(axis=1) >= least - 1)
        if not len(rows):
            continue
        i, j = np.nonzero(product[rows] >= (least[rows] - 1)[:, None])
        values = product[rows][i, j].astype(np.float64)
        i = rows[i] + at
        keep = values * sx[i] * sy[j] + ex[i] + (1 + ex[i]) * ey[j] + 1e-9 >= threshold
        if alone:
            keep &= i < j
        i, j = i[keep], j[keep]
        for cut in range(0, len(i), 1 << 16):
            yield i[cut: cut + (1 << 16)], j[cut: cut + (1 << 16)]


def _spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label over links, to a fixed point."""
    while len(a):
        least = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], least)
        np.minimum.at(new, labels[b], least)
        new = new[new]
        if (new == labels).all():
            break
        labels = new
        live = labels[a] != labels[b]
        a, b = a[live], b[live]
    while (labels[labels] != labels).any():
        labels = labels[labels]
    return labels


def _pack(kind: str, pivots: dict[int, np.ndarray]):
    """Nodes as packed bytes, with the number of the nearest pivot of their width."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [np.array(v, dtype=np.float64) for v in batch.column("vector").to_pylist()]
            cells = [int(np.argmax(pivots[len(v)] @ (v / np.abs(v).max()))) if len(v) in pivots else 0 for v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid"), batch.column("copies"), pa.array([len(v) for v in rows], pa.int32()), pa.array(cells, pa.int32()), pa.array([v.astype(kind).tobytes() for v in rows], pa.binary())],
                names=["gid", "copies", "width", "cell", "vector"])

    return pack


def _save(fs, path: str, **arrays) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    with fs.open_output_stream(path, compression=None) as sink:
        sink.write(out.getvalue())


def _load(fs, path: str) -> dict[str, np.ndarray]:
    with fs.open_input_stream(path, compression=None) as file, np.load(io.BytesIO(file.read())) as f:
        return {k: f[k] for k in f.files}


def _tile(folder: str, kind: str):
    """Write a tile; its files are named by the attempt, and only those that the returned rows name are read."""

    def write(table):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        width, name = table.column("width")[0].as_py(), uuid.uuid4().hex
        order = np.argsort(table.column("gid").to_numpy(), kind="stable")
        values = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=kind).reshape(-1, width)[order]
        unit = unit_rows(values.astype(np.float64))
        codes, scales, losses = quantise(unit)
        middle = unit.mean(axis=0)
        length = np.linalg.norm(middle)
        center = middle / length if length > 1e-9 else unit[0]
        radius = float(np.arccos(np.clip(unit @ center, -1, 1)).max())
        _save(fs, f"{base}/{name}.codes", center=center, radius=np.array(radius), gid=table.column("gid").to_numpy()[order], copies=table.column("copies").to_numpy()[order], codes=codes, scales=scales, losses=losses)
        _save(fs, f"{base}/{name}.full", vector=values)
        return pa.table({"width": pa.array([width], pa.int32()), "name": [name], "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    return write


def _strip(folder: str):
    """Write what tells whether a strip's tiles can be skipped: their names, centres and radii."""

    def write(table):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        name = uuid.uuid4().hex
        _save(fs, f"{base}/{name}.strip", names=np.array(table.column("name").to_pylist()), centers=np.array(table.column("center").to_pylist()), radii=table.column("radius").to_numpy())
        return pa.table({"width": pa.array([table.column("width")[0].as_py()], pa.int32()), "strip": pa.array([table.column("strip")[0].as_py()], pa.int32()), "file": [name]})

    return write


def _compare(folder: str, threshold: float):
    """Each row is a tile and a strip; the tile meets those of the strip with no lesser name."""

    def compare(batches):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        reach = float(np.arccos(threshold)) + SLACK
        for batch in batches:
            for row in batch.to_pylist():
                left, strip, full = _load(fs, f"{base}/{row['name']}.codes"), _load(fs, f"{base}/{row['file']}.strip"), {}
                away = np.arccos(np.clip(strip["centers"] @ left["center"], -1, 1)) - left["radius"] - strip["radii"]
                near = [name for name, x in zip(strip["names"].tolist(), away.tolist(), strict=True) if name >= row["name"] and x <= reach]

                def unit(name, full=full):
                    if name not in full:
                        if len(full) > 1:  # the row's own tile and one other
                            full.pop(next(k for k in full if k != row["name"]))
                        full[name] = unit_rows(_load(fs, f"{base}/{name}.full")["vector"].astype(np.float64))
                    return full[name]

                n = len(left["gid"])
                ours, own, roots = np.zeros(n, dtype=np.int64), np.arange(n), []
                for name in near:
                    alone = name == row["name"]
                    right = left if alone else _load(fs, f"{base}/{name}.codes")
                    theirs = ours if alone else np.zeros(len(right["gid"]), dtype=np.int64)
                    labels = own if alone else np.concatenate([own, np.arange(len(right["gid"])) + n])
                    shift, some = 0 if alone else n, False
                    for a, b in open_pairs(*[tuple(t[k] for k in ("codes", "scales", "losses")) for t in (left, right)], alone, threshold):
                        hit = np.einsum("ij,ij->i", unit(row["name"])[a], unit(name)[b]) >= threshold
                        a, b = a[hit], b[hit]
                        if len(a):
                            some = True
                            np.add.at(ours, a, right["copies"][b])
                            np.add.at(theirs, b, left["copies"][a])
                            labels = _spread(labels, a, b + shift)
                    if alone:
                        own = labels
                    elif some:  # what the tile's own rows are joined by stays with them; the other tile's rows go out now
                        own = labels[:n]
                        linked = np.flatnonzero(theirs)
                        roots.append((right["gid"][linked], theirs[linked], left["gid"][labels[n:][linked]]))
                linked = np.flatnonzero(ours)
                if len(linked):
                    roots.append((left["gid"][linked], ours[linked], left["gid"][own[linked]]))
                if not roots:
                    continue
                gid, links, other = (np.concatenate(c) for c in zip(*roots, strict=True))
                if len(gid):
                    yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(links), pa.array(other)], names=["gid", "links", "other"])

    return compare


def _pivots(nodes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Up to ``most`` unit vectors of each width (of PIVOTS rows in all), those with the least hash."""
    if most < 2:
        return {}
    rows = nodes.select("vector").orderBy(F.xxhash64("vector"), "gid").limit(min(most, PIVOTS)).collect()
    widths: dict[int, list] = {}
    for r in rows:
        widths.setdefault(len(r["vector"]), []).append(r["vector"])
    return {w: unit_rows(np.array(v, dtype=np.float64)) for w, v in widths.items()}


def links(nodes: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """(gid, links, other): link counts and a spanning forest of the distinct ``nodes`` (gid, copies, vector)."""
    spark = nodes.sparkSession
    prepare(spark)
    folder = fresh_path(spark, "vector-tiles")
    fs, base = open_filesystem(folder)
    fs.create_dir(base, recursive=True)
    n = nodes.count()
    tile = min(TILE, max(TILE_MIN, -(-n // TILES_ASKED)))
    packed = nodes.select("gid", "copies", "vector").mapInArrow(_pack(kind, _pivots(nodes, n // tile)), "gid long, copies long, width int, cell int, vector binary")
    packed = materialise(packed, "vector-cells")
    # at most PIVOTS cells a width; cells beyond a tile are cut by a hash
    cells = packed.groupBy("width", "cell").agg(F.count("*").alias("n"))
    cut = packed.join(cells, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("gid"), F.ceil(F.col("n") / tile)))
    tiles = materialise(cut.select("gid", "copies", "width", "cell", "part", "vector").groupBy("width", "cell", "part").applyInArrow(_tile(folder, kind), TILE_SCHEMA), "vector-tiles-list")
    # a tile meets every strip of its width; names are random, so strips are even
    widths = tiles.groupBy("width").agg(F.ceil(F.count("*") / STRIP).cast("int").alias("strips"))
    placed = tiles.join(widths, "width").withColumn("strip", F.pmod(F.xxhash64("name"), F.col("strips")).cast("int"))
    strips = materialise(placed.groupBy("width", "strip").applyInArrow(_strip(folder), "width int, strip int, file string"), "vector-strips")
    asked = placed.select("width", "name", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles.count())
    tasks = asked.join(strips, ["width", "strip"]).select("name", "file").repartition(spread, "name", "file")
    return materialise(tasks.mapInArrow(_compare(folder, threshold), OUT_SCHEMA), "vector-links")


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors``."""
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"  # how components are stored
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    base = base.withColumn("vector", F.when(whole, F.col("vector")))
    nodes = base.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    found = links(nodes, kind, threshold)
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("gid", "other"), "vector-cc")
    named = nodes.join(counts, "gid", "left").join(components.withColumnRenamed("node", "gid"), "gid", "left").select(
        "vector", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "gid").alias("component"))
    named = materialise(named, "vector-named")
    discard(nodes, found)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(ids, "component").select("vector", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-ids")
    out = base.join(named, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
