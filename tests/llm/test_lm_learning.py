"""The pass over all training texts against one chunk at a time, and the bounds of the numbers that place words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.llm import bpe, common, lm
from quartermark.llm.queries import rank_path


def chunked(spark, texts, parts):
    """Chunks of ``texts``, one a part; and the training texts of each."""
    docs = spark.createDataFrame([(i, i % 5 == 0, t) for i, t in enumerate(texts)], "doc_id long, held boolean, text string").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    folder = common.fresh_path(spark, "lm-test")
    fs, base = common.open_filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select("doc_id", "held", F.col("text").cast("binary").alias("text")).mapInArrow(lm._chunks(folder, rank_path()), lm.CHUNKS)
    held = [r for r in docs.select(F.spark_partition_id().alias("p"), "doc_id", "held", "text").collect() if not r["held"]]
    return common.materialise(rows, "lm-test-chunks"), folder, [[r["text"] for r in held if r["p"] == p] for p in sorted({r["p"] for r in held})]


@pytest.mark.parametrize("tasks", [1, 3])
def test_the_pass_is_the_mean_of_chunks_taken_one_at_a_time(spark, tasks):
    g = np.random.default_rng(2)
    words = ["river", "stone", "Quartz", "ember", "willow", "harbour", "violin", "x1"]
    texts = [" ".join(g.choice(words, g.integers(1, 80))) for _ in range(60)]
    chunks, folder, parts = chunked(spark, texts, 3)
    ids = [[np.array([i for w in t.lower().split() for i in bpe.encode(" " + w, rank_path())]) for t in part] for part in parts]
    start = lm.from_counts(np.bincount(np.concatenate([x for part in ids for x in part]), minlength=lm.VOCABULARY), len(texts))
    kept = {k: v.copy() for k, v in start.p.items()}
    total, weight = {k: 0.0 for k in kept}, 0
    for part in ids:
        n = sum(len(x) + 1 for x in part)
        model = lm.fit(part, 1, lm.PASS_BATCH, lm.PASS_RATE, model=lm.Attention({k: v.copy() for k, v in kept.items()}, start.rank))
        total, weight = {k: total[k] + n * v.astype(float) for k, v in model.p.items()}, weight + n
    got = lm.learn_all(chunks.coalesce(1) if tasks == 1 else chunks.repartition(tasks, "chunk"), start, folder)
    assert len(parts) == 3 and chunks.count() == 3
    for k in kept:
        assert np.allclose(got.p[k], total[k] / weight, atol=1e-5), k
    assert any(np.abs(got.p[k] - kept[k]).max() > 1e-4 for k in kept)


@pytest.mark.parametrize(("bits", "least"), [("LOCAL_BITS", 0), ("WORD_BITS", 1)])
def test_numbers_that_would_run_over_raise(spark, monkeypatch, bits, least):
    import pyarrow as pa

    monkeypatch.setattr(lm, bits, least)
    monkeypatch.setattr(lm, "CHUNK_WORDS", 3)
    monkeypatch.setattr(lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Here", (), {"partitionId": staticmethod(lambda: 0)}))}))
    folder = common.fresh_path(spark, "lm-test")
    fs, base = common.open_filesystem(folder)
    fs.create_dir(base, recursive=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "held": [False, False], "text": [b"one two three", b"four five six"]})
    with pytest.raises(ValueError, match="more partitions"):
        list(lm._chunks(folder, rank_path())(iter([batch])))
