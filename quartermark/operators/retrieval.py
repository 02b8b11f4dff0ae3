"""Filtered multi-query cosine retrieval, fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.numbers import sigmoid
from ..functions.text import citation_quote
from .store import open_filesystem, shared_folder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def metadata_filter(df: DataFrame, ticker=None, periods=None, doc_types=None, sections=None, management_only: bool = False) -> DataFrame:
    """Filters before any scoring; period pairs become an OR of ANDs, which scans can take."""
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if periods:
        asked = F.lit(False)
        for quarter, year in dict.fromkeys(periods):
            asked = asked | ((F.col("quarter") == quarter) & (F.col("fiscal_year") == year))
        df = df.where(asked)
    if doc_types:
        df = df.where(F.col("doc_type").isin(*doc_types))
    if sections:
        df = df.where(F.col("section").isin(*sections))
    return df.where("is_management") if management_only else df


#: Vectors of a tile; tiles of a file of chunks and of one of queries; queries that meet a tile at once; units of work at most.
TILE, CHUNK_TILES, QUERY_TILES, QUERY_STEP, MOST_UNITS = 2048, 64, 16, 512, 20_000


def top_k(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector", chunk_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score, rank): exact top k chunks a query in double precision, ties by chunk id.

    A stated set of queries against all chunks, in blocks: both sides are packed once into tiles of vectors of length
    one, which lie in the shared folder in files of a bounded number of tiles. A unit of work is a file of queries and
    a file of chunks; its task reads both tile by tile and keeps a running best k for the queries of the former, so a
    task's memory follows neither table and no vector is shuffled. What is ranked after it is k rows a query and file
    of chunks. Vectors without a length, or of another length than the query, score null and come last.
    """
    spark = chunks.sparkSession
    kinds = dict(queries.dtypes)[query_id], dict(chunks.dtypes)[chunk_id]
    asked = _tiles(queries, query_id, query_vector, QUERY_TILES, "query-tiles")
    held = _tiles(chunks, chunk_id, vector, CHUNK_TILES, "chunk-tiles")
    files = [sorted(r["f"] for r in t.select(F.col("_metadata.file_path").alias("f")).distinct().collect()) for t in (asked, held)]
    units = spark.createDataFrame([(q,) for q in files[0]], "asked string").select("asked", F.explode(F.lit(files[1]) if files[1] else F.array().cast("array<string>")).alias("held"))
    units = units.repartition(max(1, min(len(files[0]) * len(files[1]), MOST_UNITS)), "asked", "held")
    found = units.mapInArrow(_best(k, QUERY_STEP), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("chunk_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("chunk_id").alias(chunk_id), "score", "rank")


def _tiles(df: DataFrame, name: str, vector: str, per_file: int, label: str) -> DataFrame:
    """``df`` as rows of up to TILE ids with the bytes of their unit vectors; width 0: those without one."""
    kind = dict(df.dtypes)[name]
    path = shared_folder(df.sparkSession, label)
    out = f"width int, ids array<{kind}>, vectors binary"
    df.select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_pack(TILE), out).write.option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(out).parquet(path)


def _unit(values):
    """The unit vector of a list, or None for null, zero and non-finite ones."""
    import numpy as np

    if not values or None in values:
        return None
    x = np.array(values)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _pack(size: int):
    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {}
        kind = None

        def tile(width):
            ids, rows = held.pop(width)
            body = np.array(rows).tobytes() if width else b""
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([body], pa.binary())], names=["width", "ids", "vectors"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, values in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = _unit(values)
                width = 0 if x is None else len(x)
                ids, rows = held.setdefault(width, ([], []))
                ids.append(key)
                if x is not None:
                    rows.append(x)
                if len(ids) == size:
                    yield tile(width)
        for width in list(held):
            yield tile(width)

    return pack


def _read_tiles(uri: str):
    """(width, ids, matrix) of each tile in a file, one at a time."""
    import numpy as np
    import pyarrow.parquet as pq

    fs, path = open_filesystem(uri)
    with fs.open_input_file(path) as file:
        for batch in pq.ParquetFile(file).iter_batches(1):
            width, ids = batch.column("width")[0].as_py(), batch.column("ids")[0].values
            yield width, ids, np.frombuffer(batch.column("vectors")[0].as_py()).reshape(len(ids), width)


class _Ids:
    """Ids of a unit's chunks as sortable numpy values, nulls first."""

    def __init__(self, kind):
        import pyarrow as pa

        self.kind, self.text = kind, not pa.types.is_integer(kind)

    def keys(self, ids):
        import numpy as np

        if self.text:
            return np.array([b"" if x is None else b"1" + str(x).encode() for x in ids.to_pylist()], dtype=object)
        return ids.fill_null(-(1 << 63) if self.kind.bit_width == 64 else -(1 << 31)).to_numpy().astype(np.int64)


def _first(scores, keys, rows, n_rows: int, k: int):
    """Places of the first k of each row by score, then key."""
    import numpy as np

    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    same = np.argsort(keys, kind="stable")
    if len(keys):  # equal keys rank alike, so that scores alone don't decide between repeats
        groups = np.cumsum(np.concatenate([[False], keys[same][1:] != keys[same][:-1]]))
        rank[same] = groups
    order = np.lexsort((rank, -scores, rows))
    lead = np.searchsorted(rows[order], np.arange(n_rows))
    place = np.arange(len(order)) - lead[rows[order]]
    return order[place < k]


def _best(k: int, step: int):
    """Best k chunks of one file for the queries of another; candidates are only those that reach a query's k-th best so far."""

    def of_file(q, held, kinds):
        import numpy as np

        n, width = q.shape
        score, key, row = np.empty(0), None, np.empty(0, dtype=np.int64)
        least = np.full(n, -np.inf)
        for own, ids, matrix in _read_tiles(held):
            if own != width:
                continue
            keys = kinds.keys(ids)
            for at in range(0, n, step):
                part = slice(at, min(at + step, n))
                s = q[part] @ matrix.T
                floor = least[part]
                if s.shape[1] > k:
                    floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
                i, j = np.nonzero(s >= floor[:, None])
                mine = (row >= part.start) & (row < part.stop)
                scores = np.concatenate([score[mine], s[i, j]])
                names = keys[j] if key is None else np.concatenate([key[mine], keys[j]])
                rows = np.concatenate([row[mine], i + at])
                kept = _first(scores, names, rows - at, part.stop - part.start, k)
                other = ~mine
                score, row = np.concatenate([score[other], scores[kept]]), np.concatenate([row[other], rows[kept]])
                key = names[kept] if key is None else np.concatenate([key[other], names[kept]])
                count = np.bincount(rows[kept] - at, minlength=part.stop - part.start)
                full = np.flatnonzero(count >= k)
                worst = np.full(part.stop - part.start, np.inf)
                np.minimum.at(worst, rows[kept] - at, scores[kept])
                least[at + full] = worst[full]
        return score, key, row

    def without_score(held, width, kinds):
        """The first k keys of a file's chunks that have no score with a query of this width (0: any chunk)."""
        import numpy as np

        first = None
        for own, ids, _ in _read_tiles(held):
            if not width or own != width:
                keys = np.sort(kinds.keys(ids))[:k]
                first = keys if first is None else np.sort(np.concatenate([first, keys]))[:k]
        return first if first is not None else []

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for asked, held in zip(batch.column("asked").to_pylist(), batch.column("held").to_pylist(), strict=True):
                kinds, bare = None, {}
                for _, ids, _ in _read_tiles(held):
                    kinds = _Ids(ids.type)
                    break
                for width, queries, matrix in _read_tiles(asked):
                    if width not in bare:
                        bare[width] = without_score(held, width, kinds)
                    score, key, row = of_file(matrix, held, kinds) if width else (np.empty(0), None, np.empty(0, dtype=np.int64))
                    keys = [] if key is None else key.tolist()
                    places, names, scores = row.tolist(), list(keys), score.tolist()
                    counts = np.bincount(row, minlength=len(queries)) if len(row) else np.zeros(len(queries), dtype=int)
                    for i in np.flatnonzero(counts < k).tolist():
                        more = list(bare[width])[: k - int(counts[i])]
                        places += [i] * len(more)
                        names += more
                        scores += [None] * len(more)
                    ids = [None if x == b"" else x[1:].decode() for x in names] if kinds.text else [None if x in (-(1 << 63), -(1 << 31)) else int(x) for x in names]
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(places, pa.int64())), pa.array(ids, kinds.kind), pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "score"])

    return run


def fuse(hits: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Best score a chunk over all queries, best first."""
    return hits.groupBy(chunk_id).agg(F.max("score").alias("score")).orderBy(F.desc("score"), chunk_id)


def lexical_overlap(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """The offline pair scorer: share of query words that the text has, as a logit around zero."""

    def score(q, t):
        words = set((q or "").lower().split())
        return 4.0 * len(words & set((t or "").lower().split())) / len(words) - 2.0 if words else -2.0

    return pd.Series([score(q, t) for q, t in zip(queries, texts, strict=True)], dtype="float64")


def rerank(candidates: DataFrame, queries: DataFrame, top_n: int = DEFAULT.top_k, max_pairs: int = DEFAULT.rerank_max_pairs, scorer: Callable | None = None, n_queries: int = 1) -> DataFrame:
    """(chunk_id, relevance, mode): candidates (chunk_id, text, score) scored against all queries (query_id, query).

    The pair budget trims candidates by their first score before the quadratic step.
    ``scorer=None`` keeps vector order and says so in ``mode``.
    """
    w = Window.orderBy(F.desc("score"), "chunk_id")
    if scorer is None:
        return candidates.orderBy(F.desc("score"), "chunk_id").limit(top_n).select("chunk_id", F.col("score").alias("relevance"), F.lit("vector_order").alias("mode"))
    budget = max(1, max_pairs // max(1, n_queries))
    trimmed = candidates.orderBy(F.desc("score"), "chunk_id").limit(budget)
    pairs = trimmed.join(F.broadcast(queries.select("query_id", "query")))
    scored = pairs.withColumn("logit", F.pandas_udf(scorer, "double")("query", "text"))
    best = scored.groupBy("chunk_id").agg(F.max("logit").alias("logit"))
    return best.select("chunk_id", sigmoid(F.col("logit")).alias("relevance"), F.lit("reranked").alias("mode")).withColumn("__n", F.row_number().over(w.orderBy(F.desc("relevance"), "chunk_id"))).where(F.col("__n") <= top_n).drop("__n")


def period_evidence(chunks: DataFrame, specs: dict, vector: str = "embedding", scorer: Callable | None = None, config=DEFAULT, most_pairs: int | None = None) -> DataFrame:
    """``chunks`` (with vectors) that each kind's retrieval gives for each period, beside (kind, relevance, mode).

    ``specs`` maps a kind to a spec: its queries (text, vector), filters (doc_types, sections, management_only) and
    whether it reads all periods of the ticker (many_periods); then a chunk of another period comes under the period
    that it is evidence for, with its own in ``chunk_quarter`` and ``chunk_year``. Filters come before any scoring. Each
    query takes the best ``rerank_candidates`` by cosine, a chunk's score is its best over the queries, and the best
    ``top_k`` stay. With a ``scorer`` (queries, texts -> logits), the candidates are cut to the pair budget of a
    period and kind by score and ranked anew by their best logit; should it fail, the order by vectors stays and
    ``mode`` says ``vector_order_degraded``.

    A task gets a ticker's chunks: wanted periods x documents a period x characters a document bound them.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    fields = [f for f in chunks.schema.fields if f.name != vector]
    more = [StructField("chunk_quarter", StringType()), StructField("chunk_year", chunks.schema["fiscal_year"].dataType), StructField("kind", StringType()), StructField("relevance", DoubleType()), StructField("mode", StringType())]
    find = _period_hits(specs, vector, [f.name for f in fields], scorer, config, most_pairs or config.rerank_max_pairs)
    return chunks.groupBy("ticker").applyInPandas(find, StructType([*fields, *more]))


def _period_hits(specs, vector, columns, scorer, config, most_pairs):
    import numpy as np

    def unit(rows):
        x = np.array([v if v is not None else [] for v in rows], dtype=float) if len({len(v) if v is not None else 0 for v in rows}) == 1 else np.zeros((len(rows), 0))
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def one(kind, spec, own):
        """(places in ``own``, relevance, mode) of a kind's best for one period."""
        keep = np.ones(len(own), dtype=bool)
        if spec["doc_types"]:
            keep &= own["doc_type"].isin(spec["doc_types"]).to_numpy()
        if spec["sections"]:
            keep &= own["section"].isin(spec["sections"]).to_numpy()
        if spec["management_only"]:
            keep &= own["is_management"].fillna(False).astype(bool).to_numpy()
        at = np.flatnonzero(keep)
        if not len(at) or not spec["queries"]:
            return at[:0], [], "empty"
        ids = own["chunk_id"].to_numpy()[at]
        v, q = unit(own[vector].iloc[at].tolist()), unit([x for _, x in spec["queries"]])
        score = v @ q.T if v.shape[1] == q.shape[1] else np.zeros((len(v), len(q)))
        fused = np.full(len(at), -np.inf)
        for j in range(score.shape[1]):
            near = np.lexsort((ids, -score[:, j]))[: config.rerank_candidates]
            fused[near] = np.maximum(fused[near], score[near, j])
        order = [i for i in np.lexsort((ids, -fused)) if fused[i] > -np.inf]
        if scorer is None:
            return at[order[: config.top_k]], fused[order[: config.top_k]], "vector_order"
        order = order[: max(1, most_pairs // len(spec["queries"]))]
        try:
            texts = own["text"].iloc[at[order]].reset_index(drop=True)
            logits = np.max([np.asarray(scorer(pd.Series([q] * len(texts)), texts), dtype=float) for q, _ in spec["queries"]], axis=0)
        except Exception:  # a broken model is told, not raised: the period then isn't marked as scored
            return at[order[: config.top_k]], fused[order[: config.top_k]], "vector_order_degraded"
        best = np.lexsort((ids[order], -logits))[: config.top_k]
        return at[np.array(order)[best]], 1.0 / (1.0 + np.exp(-np.clip(logits[best], -500, 500))), "reranked"

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (quarter, year), own in rows.groupby(["quarter", "fiscal_year"], sort=True):
            for kind, spec in specs.items():
                pool = rows if spec["many_periods"] else own
                at, relevance, mode = one(kind, spec, pool)
                hit = pool.iloc[at].copy()
                hit["chunk_quarter"], hit["chunk_year"] = hit["quarter"], hit["fiscal_year"]
                hit["quarter"], hit["fiscal_year"], hit["kind"], hit["relevance"], hit["mode"] = quarter, year, kind, relevance, mode
                out.append(hit)
        names = [*columns, "chunk_quarter", "chunk_year", "kind", "relevance", "mode"]
        return pd.concat(out)[names] if out else rows.iloc[:0].reindex(columns=names)

    return find


def as_citation(chunk: str = "text") -> Column:
    return F.struct(
        "chunk_id", "doc_type", F.concat_ws(" ", "quarter", F.col("fiscal_year").cast("string")).alias("quarter"), "source_url", "speaker",
        citation_quote(F.col(chunk)).alias("quote"), F.round("score", 3).alias("relevance"))


def evidence_block(hits: DataFrame, most: int) -> DataFrame:
    """One text: the first ``most`` hits, numbered, each under a line of metadata."""
    head = F.format_string("[%d] %s | %s %s | %s\n%s", F.col("rank"), F.col("doc_type"), F.col("quarter"), F.col("fiscal_year").cast("string"), F.col("section"), F.col("text"))
    return hits.where(F.col("rank") <= most).agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("line")))), lambda x: x["line"])).alias("evidence"))
