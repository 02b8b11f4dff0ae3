"""Files to text in short batches."""

import pandas as pd
from pyspark.sql import functions as F

from quartermark.plans import registry

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_extractor_takes_files_in_short_batches(spark, tmp_path):
    before = spark.conf.get(ROWS)
    spark.conf.unset(ROWS)
    try:
        pages = spark.range(2000, numPartitions=1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("<p>word "), 60)).when(F.col("id") % 4 < 3, "short").alias("html"))
        pages.write.parquet(str(tmp_path / "pages.parquet"))
        how = registry.queries()["k06_extractor"](spark, str(tmp_path))
        assert {r["how"]: r["n"] for r in how.collect()} == {"plain": 1500, "failed": 500}
        size = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "int")
        assert spark.read.parquet(str(tmp_path / "pages.parquet")).select(F.max(size("html"))).first()[0] <= 128
    finally:
        spark.conf.set(ROWS, before)
