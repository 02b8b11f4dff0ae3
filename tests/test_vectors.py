"""The collection of vectors: nothing is embedded twice, deletions, compaction, writers at once."""

import threading

from pyspark.sql import functions as F

from quartermark.operators.vectors import VectorCollection


def chunks(spark, low, high, ticker="A", text="t"):
    return spark.range(low, high).select(F.col("id").cast("string").alias("chunk_id"), F.lit(ticker).alias("ticker"), F.lit(text).alias("text"))


def embed(seen):
    def run(df):
        seen.append(sorted(int(r["chunk_id"]) for r in df.select("chunk_id").collect()))
        return df.withColumn("embedding", F.array(F.col("chunk_id").cast("float")))

    return run


def ids(c):
    return sorted(int(r["chunk_id"]) for r in c.rows().collect())


def test_upserts_deletes_and_compaction(spark, tmp_path):
    c, seen = VectorCollection(spark, str(tmp_path)), []
    assert c.count() == 0
    assert c.upsert(chunks(spark, 0, 5), embed(seen)) == 5
    assert c.upsert(chunks(spark, 3, 8).union(chunks(spark, 3, 8)), embed(seen)) == 8
    assert seen == [[0, 1, 2, 3, 4], [5, 6, 7]]
    c.delete(spark.createDataFrame([("1",), ("1",), ("unknown",)], "chunk_id string"))
    assert ids(c) == [0, 2, 3, 4, 5, 6, 7]
    c.compact()
    assert ids(c) == [0, 2, 3, 4, 5, 6, 7] and "Window" not in c.rows()._jdf.queryExecution().executedPlan().toString()
    assert c.upsert(chunks(spark, 0, 3), embed(seen)) == 8 and seen[-1] == [1]
    c.upsert(chunks(spark, 20, 22, "B"), embed(seen))
    c.delete_ticker("A")
    assert ids(c) == [20, 21]
    assert c.upsert(chunks(spark, 0, 2), embed(seen)) == 4 and seen[-1] == [0, 1]
    c.replace(chunks(spark, 0, 1, text="new").withColumn("embedding", F.array(F.lit(9.0).cast("float"))))
    got = {r["chunk_id"]: (r["text"], r["embedding"]) for r in c.rows(chunks(spark, 0, 2)).collect()}
    assert got == {"0": ("new", [9.0]), "1": ("t", [1.0])}
    c.compact()
    assert ids(VectorCollection(spark, str(tmp_path))) == [0, 1, 20, 21]


def test_a_lookup_reads_the_buckets_of_its_ids(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path))
    c.upsert(chunks(spark, 0, 200), embed([]))
    plan = c.rows(chunks(spark, 7, 8))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert [r["chunk_id"] for r in c.rows(chunks(spark, 7, 8)).collect()] == ["7"]


def test_writers_and_a_compaction_at_once(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path))
    c.upsert(chunks(spark, 0, 10), embed([]))
    threads = [threading.Thread(target=f) for f in (
        lambda: VectorCollection(spark, str(tmp_path)).upsert(chunks(spark, 10, 20), embed([])),
        lambda: VectorCollection(spark, str(tmp_path)).delete(chunks(spark, 0, 3)),
        lambda: VectorCollection(spark, str(tmp_path)).compact())]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ids(c) == list(range(3, 20))
    c.compact()
    assert ids(c) == list(range(3, 20))


def test_ids_and_compaction_shuffle_no_more_than_they_need(spark, tmp_path, monkeypatch):
    c = VectorCollection(spark, str(tmp_path))
    c.upsert(chunks(spark, 0, 5), embed([]))
    c.upsert(chunks(spark, 3, 8), embed([]))
    plan = c.rows().select("chunk_id")._jdf.queryExecution().optimizedPlan()
    assert "text" not in plan.toString().split("Window [")[1].split("Project")[1].split("xxhash64")[0]
    whole = c.rows(placed=True)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange") == 1
