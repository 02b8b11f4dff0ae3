"""Connected components by alternating star contraction, all in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _contract(batches):
    """Per partition, replace edges by a star forest: at most one edge a node remains."""
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    held = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        held = len(parent)
        if held > 1_000_000:  # a forest is complete in itself: hand it on and start anew
            yield _forest(parent, root, np, pa)
            parent.clear()
    yield _forest(parent, root, np, pa)


def _forest(parent, root, np, pa):
    nodes = list(parent)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(nodes, dtype="int64")), pa.array(np.array([root(x) for x in nodes], dtype="int64"))],
        names=["u", "v"],
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.sum(F.col("v").bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node that has an edge to another; component = least node.

    ``edges``: two long columns. Self-loops, repeats and both directions may occur; rows
    with a null end are ignored. No group is ever gathered in a task: each round uses only
    minima by key (combined before the shuffle) and equi-joins that adaptive execution can
    split, and writes its edges to the shared folder.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    current = materialise(clean.mapInArrow(_contract, "u long, v long").where("u <> v").distinct(), label)
    before = _signature(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following = materialise(small.distinct(), label)
        discard(current, large)
        current = following
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        current.select("v", "v").distinct()
    )
