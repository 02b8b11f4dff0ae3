"""Filings as a stream: late arrivals within the lag window, each URL once, appended to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, text


def classified(announcements: DataFrame, lag_days: int = 200) -> DataFrame:
    """Dated, classified announcements; a URL counts once within the lag after its first date."""
    kind = text.classify(F.col("subject"))
    rows = announcements.withColumn("doc_type", kind).where("doc_type is not null and event_date is not null")
    rows = rows.withColumn("event_time", F.col("event_date").cast("timestamp")).withColumn("url", F.get("urls", F.lit(0)))
    rows = rows.withWatermark("event_time", f"{lag_days} days").dropDuplicatesWithinWatermark(["url"])
    return rows.withColumn("period", periods.document_period(F.col("subject"), F.col("event_date"), F.col("doc_type")))


def period_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("period.period_idx").alias("period_idx"), "doc_type").agg(F.count("*").alias("n"))


def start(spark: SparkSession, source: DataFrame, write, checkpoint: str, once: bool = True):
    """Feed each micro-batch of classified announcements to ``write(batch, batch_id)``."""
    writer = classified(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
