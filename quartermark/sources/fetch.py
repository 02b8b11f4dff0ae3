"""Downloads with ordered URL fallback behind two caches: parsed text, then raw bytes, then the network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha_key
from . import caches, pdf

SCHEMA = "url string, used string, content binary, error string"


def open_uri(url: str) -> bytes:
    """The default opener: any address that pyarrow's file systems read."""
    from pyarrow import fs

    source, path = fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)
    with source.open_input_stream(path) as file:
        return file.read()


def download(candidates: DataFrame, opener: Callable[[str], bytes] = open_uri) -> DataFrame:
    """(url, used, content, error): the first of ``urls`` that opens; a failure is a row, not a failed task."""

    def run(batches):
        import pandas as pd

        for pdf_rows in batches:
            rows = []
            for url, urls in pdf_rows[["url", "urls"]].itertuples(index=False):
                content, used, error = None, None, "no address"
                for address in urls if urls is not None else ():
                    try:
                        content, used, error = opener(address), address, None
                        break
                    except Exception as e:  # the next address may do
                        error = f"{type(e).__name__}: {e}"
                rows.append((url, used, content, error))
            yield pd.DataFrame(rows, columns=["url", "used", "content", "error"])

    return candidates.select("url", "urls").mapInPandas(run, SCHEMA)


def texts(candidates: DataFrame, parsed_cache: DataFrame, raw_cache: DataFrame, version: str, page_limit: int, opener: Callable[[str], bytes] = open_uri, cascade=pdf.CASCADE) -> DataFrame:
    """(url, text, how): from the parsed cache, else parsed from cached bytes, else from the network.

    ``raw_cache`` is (cache_key, content).
    """
    hits, misses = caches.split_hits(candidates, parsed_cache, version, page_limit)
    raw = raw_cache.select("cache_key", "content").dropDuplicates(["cache_key"])
    stored = misses.select("url", "cache_key").join(raw, "cache_key").select("url", "content")
    fetched = download(misses.join(raw, "cache_key", "left_anti"), opener).where("content is not null").select("url", "content")
    parsed = stored.unionByName(fetched).select("url", pdf.extract(F.col("content"), cascade).alias("r")).select("url", "r.text", "r.how")
    return hits.select("url", "text", F.lit("cache").alias("how")).unionByName(parsed)


def raw_entries(downloaded: DataFrame) -> DataFrame:
    return downloaded.where("content is not null").select(sha_key(F.col("url"), 32).alias("cache_key"), "content")
