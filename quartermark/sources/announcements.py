"""Exchange announcements: paged batch sources over captured pages, and their projections."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import periods, text

RAW_NSE = "desc string, attchmntText string, attchmntFile string, an_dt string"
RAW_BSE = "HEADLINE string, NEWSSUB string, ATTACHMENTNAME string, NEWS_DT string, DT_TM string"
# Where attachments of the second exchange may lie, and the date forms read.
BSE_BASES = ("https://www.bseindia.com/xml-data/corpfiling/AttachLive/", "https://www.bseindia.com/xml-data/corpfiling/AttachHis/")
DATE_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "dd-MMM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")
# Scrip codes by symbol.
SCRIPS = {
    "INFY": "500209", "TCS": "532540", "RELIANCE": "500325", "HDFCBANK": "500180", "ICICIBANK": "532174",
    "SBIN": "500112", "HINDUNILVR": "500696", "BHARTIARTL": "532454", "ITC": "500875", "WIPRO": "507685",
}


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    """A partition a page; a page that cannot be read gives no rows, the others stand."""

    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        self.options = options

    def partitions(self):
        first = _page(self.options, 1)
        total = int((first[0] if first else {}).get("TotalPageCnt") or 1)
        return [Page(i) for i in range(1, min(total, int(self.options.get("max_pages", 5))) + 1)]

    def read(self, partition):
        for row in _page(self.options, partition.number):
            yield tuple(row.get(f) for f in self.fields)


def _page(options, number: int) -> list[dict]:
    from pyarrow import fs

    uri = options["path"].rstrip("/") + f"/page{number}.json"
    source, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    try:
        with source.open_input_stream(path) as file:
            data = json.loads(file.read())
    except (OSError, ValueError):
        return []
    return data["Table"] if isinstance(data, dict) else data


class NseSource(DataSource):
    @classmethod
    def name(cls):
        return "nse_announcements"

    def schema(self):
        return RAW_NSE

    def reader(self, schema):
        return PagedReader(schema, self.options)


class BseSource(NseSource):
    @classmethod
    def name(cls):
        return "bse_announcements"

    def schema(self):
        return RAW_BSE


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NseSource)
    spark.dataSource.register(BseSource)


def lenient_time(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMS]).cast("timestamp_ntz")


def nse_rows(raw: DataFrame) -> DataFrame:
    return raw.where("attchmntFile is not null and attchmntFile <> ''").select(
        F.lit("NSE").alias("source"), F.trim(F.concat_ws(" ", "desc", "attchmntText")).alias("subject"),
        F.array("attchmntFile").alias("urls"), lenient_time(F.col("an_dt")).alias("event_date"))


def bse_rows(raw: DataFrame, bases=BSE_BASES) -> DataFrame:
    return raw.where("ATTACHMENTNAME is not null and ATTACHMENTNAME <> ''").select(
        F.lit("BSE").alias("source"), F.trim(F.concat_ws(" ", "HEADLINE", "NEWSSUB")).alias("subject"),
        F.array(*[F.concat(F.lit(b), "ATTACHMENTNAME") for b in bases]).alias("urls"),
        F.coalesce(lenient_time(F.col("NEWS_DT")), lenient_time(F.col("DT_TM"))).alias("event_date"))


def scrip_codes(symbols: DataFrame, known: dict[str, str] | None = None, lookup: Callable | None = None, symbol: str = "symbol", explicit: str = "scrip") -> DataFrame:
    """``resolved``: the explicit code, else the static map's, else ``lookup`` (a Column function)."""
    table = F.create_map(*[F.lit(x) for pair in (known or SCRIPS).items() for x in pair])
    found = [F.col(explicit), F.element_at(table, F.upper(symbol))] + ([lookup(F.col(symbol))] if lookup else [])
    return symbols.withColumn("resolved", F.coalesce(*found))


def candidates(announcements: DataFrame, wanted: DataFrame, allowed=text.DEFAULT_DOC_TYPES, most: int = 15, recency: str = "oldest", ordinal: str = "ordinal", by: tuple[str, ...] = ()) -> DataFrame:
    """Classified, dated, wanted, one a URL, at most ``most`` a period; each value of the columns ``by`` (such as the ticker) by itself.

    A URL counts as seen only once it fell into a wanted period; within a period documents
    rank by type, then date (nulls first when the oldest are kept), then arrival.
    """
    from pyspark.sql import Window

    kind = text.classify(F.col("subject"), allowed)
    dated = announcements.withColumn("doc_type", kind).where("doc_type is not null")
    dated = dated.withColumn("__p", periods.document_period(F.col("subject"), F.col("event_date"), F.col("doc_type")))
    dated = dated.select("*", F.col("__p.period_idx").alias("period_idx"), F.col("__p.source").alias("dated_by")).drop("__p").where("period_idx is not null")
    kept = dated.join(F.broadcast(wanted.select("period_idx").distinct()), "period_idx", "left_semi")
    kept = kept.withColumn("url", F.get("urls", F.lit(0)))
    first = Window.partitionBy(*by, "url").orderBy(ordinal)
    kept = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    date = F.col("event_date").asc_nulls_first() if recency == "oldest" else F.col("event_date").desc_nulls_last()
    rank = Window.partitionBy(*by, "period_idx").orderBy(text.type_priority(F.col("doc_type")), date, ordinal)
    return kept.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).drop("__n")
