"""Caches as tables: parsed text, raw files, narration; a hit is an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha_key


def split_hits(urls: DataFrame, cache: DataFrame, version: str, page_limit: int, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(hits with text, misses): an entry counts only for this parser version and page limit."""
    keyed = urls.withColumn("cache_key", sha_key(F.col(url), 32))
    valid = cache.where((F.col("version") == version) & (F.col("page_limit") == page_limit)).dropDuplicates(["cache_key"])
    return keyed.join(valid.select("cache_key", "text"), "cache_key"), keyed.join(valid, "cache_key", "left_anti")


def entries(parsed: DataFrame, version: str, page_limit: int, url: str = "url") -> DataFrame:
    return parsed.select(sha_key(F.col(url), 32).alias("cache_key"), F.lit(version).alias("version"), F.lit(page_limit).alias("page_limit"), "text")


def stats(cache: DataFrame, body: str = "text") -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"))
