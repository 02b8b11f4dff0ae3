import datetime as dt

import pytest
from pyspark.sql import functions as F

from quartermark.functions import jsonfn, numbers, periods, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'timestamp_ntz' if isinstance(v, dt.datetime) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("r")).first()["r"]


def idx(quarter, year):
    return year * 4 + quarter - 1


@pytest.mark.parametrize("subject, want", [
    ("Results for the quarter ended June 30, 2025", idx(1, 2026)),
    ("Results for the quarter ended 30th June, 2025", idx(1, 2026)),
    ("Audited financial results for year ended 31.03.2026", idx(4, 2026)),
    ("Audited financial results for year ended 31/03/26", idx(4, 2026)),
    ("Investor presentation Q3 FY26", idx(3, 2026)),
    ("Investor presentation Q3 FY2026", idx(3, 2026)),
    ("quarter ended 30.06.2025 and declaration of dividend", idx(1, 2026)),
    ("Results for the quarter ended 31st Dec 25", idx(3, 2026)),
    ("Results for the quarter ended June 30, 1985", None),
    ("Transcript of earnings call", None),
    (None, None),
])
def test_period_from_subject(spark, subject, want):
    assert one(spark, periods.period_from_subject(F.col("s")), s=subject) == want


@pytest.mark.parametrize("day, want", [(dt.datetime(2026, 6, 15), ("Q1", 2027)), (dt.datetime(2025, 12, 31), ("Q3", 2026)), (dt.datetime(2026, 2, 1), ("Q4", 2026))])
def test_fiscal_quarter(spark, day, want):
    p = periods.period_idx(F.col("d"))
    got = one(spark, F.struct(periods.quarter_of(p).alias("q"), periods.year_of(p).alias("y"), periods.fiscal_year(F.col("d")).alias("z")), d=day)
    assert (got["q"], got["y"]) == want and got["z"] == want[1]


def test_document_period_prefers_subject_and_annual_reports_go_by_date(spark):
    row = dict(s="Results for the quarter ended June 30, 2025", d=dt.datetime(2026, 2, 10), k="annual_report")
    assert one(spark, periods.document_period(F.col("s"), F.col("d")), **row).asDict() == {"period_idx": idx(1, 2026), "source": "subject"}
    assert one(spark, periods.document_period(F.col("s"), F.col("d"), F.col("k")), **row).asDict() == {"period_idx": idx(3, 2026), "source": "event_date"}


def test_quarter_bounds_and_window(spark):
    b = one(spark, F.struct(periods.quarter_start(F.col("i")).alias("a"), periods.quarter_end(F.col("i")).alias("b")), i=idx(1, 2026))
    assert b["a"] == dt.datetime(2025, 4, 1) and b["b"] == dt.datetime(2025, 6, 30, 23, 59, 59)
    now = F.lit("2025-07-10 00:00:00").cast("timestamp_ntz")
    assert one(spark, periods.search_window(F.col("i"), now)["end"], i=idx(1, 2026)) == dt.datetime(2025, 7, 10)
    early = F.lit("2024-07-10 00:00:00").cast("timestamp_ntz")
    assert one(spark, periods.search_window(F.col("i"), early)["end"], i=idx(1, 2026)) == dt.datetime(2025, 4, 1)


@pytest.mark.parametrize("label, want", [("Q1 FY27", ("Q1", 2027)), ("Q1 2027", ("Q1", 2027)), ("Q2 soon", ("Q2", None))])
def test_parse_period(spark, label, want):
    assert tuple(one(spark, periods.parse_period(F.col("s")), s=label)) == want


def test_format_period(spark):
    assert one(spark, periods.format_period(F.col("q"), F.col("y")), q="Q1", y=2027) == "Q1 FY27"
    assert one(spark, periods.format_period(F.col("q"), F.col("y")), q="Q1", y="n/a") == "Q1 n/a"


@pytest.mark.parametrize("subject, want", [
    ("Transcript of the call", "earnings_call"), ("Analyst Presentation", "investor_presentation"), ("Annual Report 2024", "annual_report"),
    ("Outcome of Board Meeting", "press_release"), ("Newspaper publication", None), ("Closure of trading window", None), (None, None),
])
def test_classify(spark, subject, want):
    assert one(spark, text.classify(F.col("s")), s=subject) == want


@pytest.mark.parametrize("raw, want", [("“Margins  rose” – again", "margins rose\" - again"), ("ﬁnal answer", "final answer"), (None, ""), ("'quoted'", "quoted"), ("a , b", "a , b")])
def test_normalize_quote(spark, raw, want):
    assert one(spark, text.normalize_quote(F.col("s")), s=raw) == want


def test_citation_quote_cuts_at_a_space(spark):
    long = "word " * 40
    got = one(spark, text.citation_quote(F.col("s")), s=long)
    assert got.endswith("word…") and len(got) <= 121
    assert one(spark, text.citation_quote(F.col("s")), s="short") == "short"


@pytest.mark.parametrize("raw", ['```json\n{"k": 3,}\n```', 'Here: {“k”: 3} done', '{"k":\x01 3}'])
def test_json_repair(spark, raw):
    assert one(spark, jsonfn.payload(F.col("s"), "k int")["k"], s=raw) == 3


def test_bad_json_gives_the_default(spark):
    assert one(spark, jsonfn.decode(F.col("s"), "array<int>", F.array().cast("array<int>")), s="nonsense") in ([], None)


@pytest.mark.parametrize("x, digits", [(0.25, 1), (2.675, 2), (0.35, 1), (72.5, 0), (-0.05, 1), (1234.25, 1)])
def test_python_rounding(spark, x, digits):
    assert one(spark, numbers.py_round(F.col("x"), digits), x=x) == round(x, digits)


def test_ratio_from_zero(spark):
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=0, b=0) == 1.0
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=2, b=0) == float("inf")
    assert one(spark, numbers.ratio(F.col("a"), F.col("b"), True), a=0, b=0) == float("inf")
