"""Retrieval over the vectors and chunks, chunking, and the seams with their offline defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import providers
from ..operators import chunking, retrieval
from .domain import docs, lines, query, table

TOP = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), sc AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(qv, embedding::DOUBLE[]) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


def _top(s, d, k):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_k(q, e.withColumnRenamed("vec_id", "chunk_id"), k)


@query("f04_cosine_topk", f"{TOP} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 12")
def _(s, d):
    return _top(s, d, 12).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("f05_multi_query_fusion", f"{TOP} SELECT chunk_id, round(max(score), 6) AS score FROM r WHERE rank <= 25 GROUP BY chunk_id")
def _(s, d):
    return retrieval.fuse(_top(s, d, 25)).select("chunk_id", F.round("score", 6).alias("score"))


@query("d12_max_fusion", f"{TOP} SELECT chunk_id, max(rank)::BIGINT AS worst, round(max(score), 6) AS best FROM r WHERE rank <= 8 GROUP BY chunk_id")
def _(s, d):
    return _top(s, d, 8).groupBy("chunk_id").agg(F.max("rank").cast("long").alias("worst"), F.round(F.max("score"), 6).alias("best"))


@query("f06_rerank")
def _(s, d):
    """Lexical reranking of long lines against four standing queries."""
    q = s.createDataFrame([(0, "the of and to"), (1, "demand growth in the"), (2, "de la que en"), (3, "der die und")], "query_id int, query string")
    c = lines(s, d).select("chunk_id", F.col("line").alias("text"), F.length("line").cast("double").alias("score")).dropDuplicates(["chunk_id"])
    return retrieval.rerank(c, q, scorer=retrieval.lexical_overlap, n_queries=4)


@query("d13_rerank_degraded", "SELECT chunk_id, relevance, 'vector_order' AS mode FROM (SELECT chunk_id, max(length(line))::DOUBLE AS relevance FROM lines GROUP BY 1) ORDER BY relevance DESC, chunk_id LIMIT 12")
def _(s, d):
    c = lines(s, d).groupBy("chunk_id").agg(F.max(F.length("line")).cast("double").alias("score"))
    return retrieval.rerank(c, None)


def _documents(s, d):
    t = docs(s, d)
    return t.select(
        F.col("doc_id").cast("string").alias("doc_id"), "ticker", F.lit("").alias("company"), "doc_type", "quarter", "fiscal_year", F.lit(None).cast("timestamp_ntz").alias("event_date"),
        "source_url", F.lit("title").alias("title"), F.concat(F.lit("# Results\nJohn Smith, CEO: thanks.\nJane Roe: "), F.col("text")).alias("raw_text"))


@query("f07_chunk_documents")
def _(s, d):
    return chunking.chunk_documents(_documents(s, d)).select("chunk_id", "doc_id", "section", "speaker", "is_management", "char_start", F.length("text").alias("n"))


@query("e09_sentence_packing")
def _(s, d):
    c = chunking.chunk_documents(_documents(s, d))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("f08_table_islands", """WITH t AS (SELECT doc_id, pos, line, CASE WHEN starts_with(trim(line), '|') OR ends_with(trim(line), '|') THEN 1 ELSE 0 END AS k FROM lines), c AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS edge FROM t),
b AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS block FROM c) SELECT doc_id, block, max(k) AS is_table, count(*) AS n FROM b GROUP BY 1, 2""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    k = (F.trim("line").startswith("|") | F.trim("line").endswith("|")).cast("int")
    t = lines(s, d).withColumn("k", k)
    t = t.withColumn("edge", (~F.col("k").eqNullSafe(F.lag("k").over(w))).cast("int"))
    t = t.withColumn("block", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("doc_id", "block").agg(F.max("k").alias("is_table"), F.count("*").alias("n"))


@query("f10_evidence_block")
def _(s, d):
    hits = lines(s, d).where("ticker = 'src1' and period_idx = 8101").select("doc_type", F.lit("Q2").alias("quarter"), F.lit(2025).alias("fiscal_year"), F.lit("unknown").alias("section"), F.col("line").alias("text"), "doc_id", "pos")
    from pyspark.sql import Window

    first = hits.orderBy("doc_id", "pos").limit(5)
    return retrieval.evidence_block(first.withColumn("rank", F.row_number().over(Window.orderBy("doc_id", "pos"))), 5)


@query("f11_citations", """SELECT chunk_id, doc_id, CASE WHEN length(line) <= 120 THEN line ELSE regexp_replace(substr(line, 1, 120), ' [^ ]*$', '') || '…' END AS quote, 'Q' || (period_idx % 4 + 1) || ' ' || (period_idx // 4) AS label, round(pos / 7::DOUBLE, 3) AS relevance FROM lines""")
def _(s, d):
    from ..functions import periods

    t = lines(s, d).withColumns({"quarter": periods.quarter_of(F.col("period_idx")), "fiscal_year": periods.year_of(F.col("period_idx")), "source_url": F.lit(""), "speaker": F.lit(""), "score": F.col("pos") / 7})
    return t.select("chunk_id", "doc_id", retrieval.as_citation("line").alias("c")).select("chunk_id", "doc_id", "c.quote", F.col("c.quarter").alias("label"), "c.relevance")


@query("f12_hashed_embedding")
def _(s, d):
    e = table(s, d, "benchmark").select("item_id", providers.hashed_embedding(F.col("text")).alias("v"))
    return e.select("item_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


@query("f16_extraction_prompt", "SELECT ticker, period_idx, md5(string_agg('[' || n || '] ' || line, chr(10) ORDER BY n)) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_idx ORDER BY doc_id, pos) AS n FROM lines) WHERE n <= 10 GROUP BY 1, 2")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "period_idx").orderBy("doc_id", "pos")
    top = lines(s, d).withColumn("n", F.row_number().over(w)).where("n <= 10").select("ticker", "period_idx", "n", F.format_string("[%d] %s", "n", "line").alias("told"))
    g = top.groupBy("ticker", "period_idx").agg(F.array_sort(F.collect_list(F.struct("n", "told"))).alias("p"))
    return g.select("ticker", "period_idx", F.md5(F.concat_ws("\n", F.transform("p", lambda x: x["told"])).cast("binary")).alias("prompt"))


@query("k01_completer")
def _(s, d):
    prompts = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("count").alias("system"), F.col("text").alias("user"))
    return providers.complete(prompts)


@query("l03_ingest_counts")
def _(s, d):
    from ..operators.pipeline import ingest

    t = _documents(s, d)
    stored = chunking.chunk_documents(t.where("doc_type = 'earnings_call'"))
    return ingest(t, stored)[1]
