"""Nine consistency checks over stored signals, each a DataFrame of findings, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compare
from .aggregates import verdict

KEYS = ["ticker", "period_idx"]


def citation_periods(citations: DataFrame, known: DataFrame) -> DataFrame:
    """M01. Citations (kind, ticker, period_idx, cited_idx): a signal cites its own period;
    guidance may cite any known one; an undated citation is a warning."""
    k = known.select("ticker", F.col("period_idx").alias("cited_idx")).distinct()
    bad = citations.where("kind <> 'guidance' and cited_idx is not null and cited_idx <> period_idx")
    strange = citations.where("kind = 'guidance' and cited_idx is not null").join(k, ["ticker", "cited_idx"], "left_anti").select(*citations.columns)
    undated = citations.where("cited_idx is null").withColumn("status", F.lit("WARN"))
    return bad.unionByName(strange).withColumn("status", F.lit("FAIL")).unionByName(undated)


def shared_evidence(cited: DataFrame) -> DataFrame:
    """M02. Pairs of periods of a ticker that cite the same chunk, from (ticker, period_idx, chunk_id)."""
    c = cited.distinct()
    other = c.select("ticker", "chunk_id", F.col("period_idx").alias("other_idx"))
    return c.join(other, ["ticker", "chunk_id"]).where("period_idx < other_idx").groupBy("ticker", "period_idx", "other_idx").agg(F.count("*").alias("shared"))


def unverified_quotes(quotes: DataFrame, corpus: DataFrame, least: int = 20) -> DataFrame:
    """M03. Quotes (quote_id, text) of ``least`` normalised characters that no document (doc_id, text) contains."""
    asked = quotes.where(F.length("text") >= least)
    hits = compare.contained(asked, "text", corpus, "text", "quote_id", "doc_id")
    return asked.join(hits.select("quote_id").distinct(), "quote_id", "left_anti")


def urls_in_two_periods(docs: DataFrame) -> DataFrame:
    """M04."""
    pairs = docs.where("source_url is not null and source_url <> ''").select("source_url", "period_idx").distinct()
    return pairs.groupBy("source_url").agg(F.count("*").alias("n_periods")).where("n_periods > 1")


def guidance_arithmetic(signals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """M05. Rows whose score, beat rate or serial flag disagree with their counts."""
    tracked = F.col("beats") + F.col("misses") + F.col("in_line")
    scored = (tracked == 0) & F.col("score").isNotNull()
    rate = (tracked > 0) & (F.abs(F.col("beat_rate") - F.col("beats") / tracked) > tolerance)
    problem = F.when(scored, "score without outcomes").when(rate, "beat rate")
    return signals.withColumn("problem", problem).where("problem is not null")


def theme_deltas(themes: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """M06."""
    off = (F.col("count_change") != F.col("cur") - F.col("prev")) | (F.abs(F.col("sentiment_change") - (F.col("sentiment") - F.col("prev_sentiment"))) > tolerance)
    return themes.where(off)


def narrated_priors(summaries: DataFrame, text: str = "summary") -> DataFrame:
    """M07. Sentences that tell a score's move between two numbers, which no stored summary may."""
    moved = r"(?i)\b(rose|fell|increased|decreased|improved|declined|up|down)\b.*\bfrom\s+\d+(\.\d+)?\s+to\s+\d+(\.\d+)?"
    sentences = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: s.rlike(moved) & s.rlike(r"(?i)\b(score|confidence|credibility)\b"))
    return summaries.withColumn("sentence", F.explode(sentences))


def stored_priors(signals: DataFrame) -> DataFrame:
    """M08."""
    return signals.where("previous_score is not null")


def thin_coverage(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """M09. No documents behind a scored period: FAIL; one: WARN."""
    n = docs.groupBy(*KEYS).agg(F.count("*").alias("n_docs"))
    found = scored.select(*KEYS).distinct().join(n, KEYS, "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return found.withColumn("status", F.when(F.col("n_docs") == 0, "FAIL").when(F.col("n_docs") == 1, "WARN")).where("status is not null")


def summarise(name: str, findings: DataFrame, inputs: DataFrame, severity: str = "FAIL") -> DataFrame:
    """(check, status, items): SKIP without inputs, PASS without findings, else the gravest status."""
    status = F.col("status") if "status" in findings.columns else F.lit(severity)
    n = findings.agg(F.count("*").alias("items"), F.count_if(status == "FAIL").alias("fails"))
    some = inputs.limit(1).agg(F.count("*").alias("some"))
    return n.join(F.broadcast(some)).select(
        F.lit(name).alias("check"),
        F.when(F.col("some") == 0, "SKIP").when(F.col("items") == 0, "PASS").when(F.col("fails") > 0, "FAIL").otherwise("WARN").alias("status"), "items")


def report(results: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    return rows, verdict(rows)


def exit_code(label: str) -> int:
    return {"DEFENSIBLE": 0, "WARN": 0, "NOT TRUSTWORTHY": 1}.get(label, 2)
