"""Plans that the design relies on."""

from conftest import SF

from quartermark.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ticker_filter_reaches_the_scan_through_latest_wins(spark):
    text = plan(registry.queries()["b01_confidence_history"](spark, SF))
    assert "EqualTo(o_custkey,10)" in text and "TakeOrderedAndProject" in text


def test_latest_wins_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.queries()["e01_latest_wins"](spark, SF))


def test_period_pairs_are_pushed_as_alternatives(spark):
    path = f"{SF}/lineitem.parquet"
    from quartermark.operators.retrieval import metadata_filter

    df = spark.read.parquet(path).withColumnsRenamed({"l_returnflag": "quarter", "l_linenumber": "fiscal_year"})
    text = plan(metadata_filter(df, periods=[("A", 1), ("N", 2)]))
    assert "PushedFilters: [Or(And(EqualTo(l_returnflag,A),EqualTo(l_linenumber,1))" in text


def test_scoring_stays_in_the_jvm(spark):
    for name in ("i01_confidence_score", "i06_guidance_score", "i10_theme_status", "h08_period_from_subject", "c13_containment", "flagship_guidance_credibility"):
        text = plan(registry.queries()[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text, name


def test_signal_scans_read_only_their_columns(spark):
    text = plan(registry.queries()["d01_count_by_ticker"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint>" in text
