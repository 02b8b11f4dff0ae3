"""Aggregations of signals and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import severity_rank


def outcome_counts(items: DataFrame, keys, outcome: str = "outcome") -> DataFrame:
    def n(label):
        return F.count_if(F.col(outcome) == label).alias({"beat": "beats", "miss": "misses", "withdrew": "withdrawals"}.get(label, label))

    return items.groupBy(*keys).agg(n("beat"), n("in_line"), n("miss"), n("withdrew"))


def hit_rates(df: DataFrame) -> DataFrame:
    tracked = F.col("beats") + F.col("in_line") + F.col("misses")
    return df.withColumn("tracked", tracked).withColumns({
        "hit_rate": F.try_divide(F.col("beats") + F.col("in_line"), F.col("tracked")),
        "beat_rate": F.try_divide(F.col("beats"), F.col("tracked")),
    })


def ytd_guidance(signals: DataFrame) -> DataFrame:
    """Sums over a fiscal year's quarters; rates are null where nothing was tracked."""
    sums = signals.groupBy("ticker", "fiscal_year").agg(
        F.sum("beats").alias("beats"), F.sum("in_line").alias("in_line"), F.sum("misses").alias("misses"),
        F.array_sort(F.collect_set("quarter")).alias("quarters"))
    return hit_rates(sums)


def serial_misses(items: DataFrame, keys, metric: str = "metric", outcome: str = "outcome", least: int = 2) -> DataFrame:
    name = F.lower(F.trim(F.col(metric)))
    missed = items.where((F.col(outcome) == "miss") & (name != "")).select(*keys, name.alias("metric"))
    return missed.groupBy(*keys, "metric").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ordered_distinct(df: DataFrame, keys, value: str, order) -> DataFrame:
    """(keys, value, first): each value once, with where it first occurred."""
    return df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first"))


def ytd_risks(events: DataFrame, keys=("ticker", "fiscal_year")) -> DataFrame:
    """From (keys, q, pos, list, risk, severity): names in first-seen order for each list, the
    active ones (new but not diminishing) and the severest label of each risk."""
    seen = events.groupBy(*keys, "list", "risk").agg(F.min(F.struct("q", "pos")).alias("first"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))

    def names(kind):
        picked = F.collect_list(F.when(F.col("list") == kind, F.struct("first", "risk")))
        return F.transform(F.array_sort(picked), lambda x: x["risk"]).alias(kind)

    out = seen.groupBy(*keys).agg(names("new"), names("escalating"), names("diminishing"))
    return out.withColumn("active", F.array_except("new", "diminishing"))


def verdict(results: DataFrame) -> DataFrame:
    """One row: counts of statuses and the verdict; fewer than three real checks are inconclusive."""
    n = results.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "WARN", "SKIP")])
    real = F.col("pass") + F.col("fail") + F.col("warn")
    label = F.when(F.col("fail") > 0, "NOT TRUSTWORTHY").when(real < 3, "INCONCLUSIVE").when(F.col("warn") > 0, "WARN").otherwise("DEFENSIBLE")
    return n.withColumn("verdict", label)
