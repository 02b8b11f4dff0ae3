"""Comparisons take their table once, and null keys or gaps match nothing."""

from quartermark.operators import compare


def test_the_table_is_read_once(spark):
    rows = [("A", 1, 1.0), ("A", 2, None), ("A", 3, 3.0), ("A", 6, 6.0), ("A", 7, 7.0), ("B", 2, 9.0), (None, 2, 5.0), (None, 3, 4.0), ("C", None, 8.0)]
    t = spark.createDataFrame(rows, "ticker string, period_idx int, score double").repartition(2, "period_idx")
    out = compare.comparison(t, ["score"])
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}
    by = {(t_, p): s for t_, p, s in rows if t_ is not None and p is not None}
    assert got == {(t_, p, s): tuple(by.get((t_, p - n)) if t_ is not None and p is not None else None for n in (1, 4)) for t_, p, s in rows}
    assert out.columns == ["ticker", "period_idx", "score", "score_qoq", "score_yoy"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
