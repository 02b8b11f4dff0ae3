"""Files to text: a cascade of pluggable extractors that never raises."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_bytes(data: bytes) -> str:
    """The offline extractor: files that are text already."""
    return data.decode("utf-8") if not data.startswith(b"%PDF") else ""


def pypdf_text(data: bytes) -> str:
    import io

    import pypdf

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


#: Rows and bytes of an Arrow batch of files, at most about.
BATCH_ROWS, BATCH_BYTES = 128, 1 << 24


def bounded(spark: SparkSession) -> None:
    """Keep batches of files short, so that a worker's memory follows neither the table nor the files' sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


CASCADE = (("pypdf", pypdf_text), ("plain", plain_bytes))


def extract(content: Column, cascade=CASCADE, least: int = 200) -> Column:
    """struct(text, how): the first extractor that gives ``least`` characters, else the longest text."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for data in values:
            best = ("", "failed")
            for name, tool in cascade:
                try:
                    found = tool(bytes(data)) if data is not None else ""
                except Exception:  # a bad file is a row without text, not a failed task
                    continue
                if len(found) > len(best[0]):
                    best = (found, name)
                if len(found) >= least:
                    break
            rows.append(best)
        return pd.DataFrame(rows, columns=["text", "how"])

    return F.pandas_udf(run, "text string, how string")(content)


def route(doc_type: Column, pages: Column, allowed, page_cap: int, page_limit: int) -> Column:
    """struct(parser, pages): the rich parser only for allowed types and sizes."""
    rich = doc_type.isin(*allowed) & (pages <= page_cap)
    return F.struct(F.when(rich, "rich").otherwise("plain").alias("parser"), F.least(pages, F.when(rich, page_limit).otherwise(pages)).alias("pages"))


def read_files(spark, path: str, cascade=CASCADE) -> DataFrame:
    bounded(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", extract(F.col("content"), cascade).alias("parsed")).select("path", "length", "parsed.text", "parsed.how")
