import pytest
from pyspark.sql import functions as F

from quartermark.operators import scoring

FEATURES = "tone double, hedges double, defensive int, wide boolean, superlatives int, avoidance boolean"


def features(spark, row):
    return spark.createDataFrame([row], FEATURES), {c.split()[0]: F.col(c.split()[0]) for c in FEATURES.split(", ")}


@pytest.mark.parametrize("row, want", [
    ((0.0, 0.0, 0, False, 0, False), 7.0), ((0.5, 9.0, 5, True, 3, True), 5.2), ((1.0, 0.0, 0, False, 5, False), 9.8), ((-1.0, 20.0, 9, True, 0, True), 0.0),
])
def test_confidence(spark, row, want):
    df, f = features(spark, row)
    m = scoring.manifest(scoring.CONFIDENCE_BASE, scoring.confidence_ledger(f), 0.0, 10.0)
    got = df.select(scoring.confidence_score(f).alias("s"), m.alias("m")).first()
    assert got["s"] == want
    assert round(got["m"]["baseline"] + sum(i["delta"] for i in got["m"]["items"]), 9) == round(got["m"]["raw_total"], 9)
    assert 0 <= got["m"]["total"] <= 10 and got["m"]["clamped"] == (got["m"]["total"] != got["m"]["raw_total"])


@pytest.mark.parametrize("row, want", [((0.5, 9.0, 5, True, 3, True), [4.9, 7.2, 5.6, 6.0, 5.0, 8.5]), ((0.0, 0.0, 0, False, 0, False), [5.0, 10.0, 10.0, 6.0, 7.0, 5.0])])
def test_sub_dimensions(spark, row, want):
    df, f = features(spark, row)
    assert list(df.select(*[v.alias(k) for k, v in scoring.sub_dimensions(f).items()]).first()) == want


GUIDANCE = [("beat beat miss beat in_line", 66, 58), ("beat beat", 70, 62), ("miss miss", 20, 12), ("miss miss beat", 32, 24), ("in_line " * 4, 67, 59), ("beat " * 12, 90, 82), ("", None, None)]


@pytest.mark.parametrize("outcomes, plain, withdrew", GUIDANCE)
def test_guidance(spark, outcomes, plain, withdrew):
    df = spark.createDataFrame([(outcomes.split(),)], "o array<string>")

    def n(label):
        return F.size(F.filter("o", lambda x: x == label))

    args = (n("beat"), n("in_line"), F.size("o"), scoring.miss_streak(F.col("o")))
    got = df.select(scoring.guidance_score(*args), scoring.guidance_score(*args, withdrew=F.lit(True))).first()
    assert tuple(got) == (plain, withdrew)


@pytest.mark.parametrize("row, want", [
    ((12, 4, -0.4, 0.1), "newly_risky"), ((3, 0, 0.2, 0.0), "emerging"), ((3, 1, -0.1, 0.0), "emerging"), ((0, 5, 0.0, 0.3), "fading"), ((2, 4, 0.1, 0.1), "fading"), ((6, 4, 0.2, 0.2), "accelerating"),
    ((6, 4, 0.0, 0.0), "stable"), ((1, 0, 0.5, 0.0), "accelerating"), ((4, 4, 0.3, 0.3), "stable"), ((3, 4, -0.3, -0.4), "stable"), ((0, 0, 0.0, 0.0), "fading"),
])
def test_theme_status(spark, row, want):
    df = spark.createDataFrame([row], "a int, b int, c double, d double")
    assert df.select(scoring.theme_status(*[F.col(c) for c in "abcd"])).first()[0] == want


@pytest.mark.parametrize("row, magnitude, status", [
    ((12, 4, -0.4, 0.1, False), 0.90, "accelerating"), ((3, 0, 0.2, 0.0, True), 0.58, "new"), ((0, 5, 0.0, 0.3, False), 0.78, "dropped"),
    ((5, 4, 0.1, 0.1, False), 0.15, "building"), ((4, 4, 0.1, 0.1, False), 0.0, "stable"), ((3, 4, 0.0, 0.0, False), 0.15, "fading"),
])
def test_narrative_package_rules(spark, row, magnitude, status):
    df = spark.createDataFrame([row], "a int, b int, c double, d double, e boolean")
    p = [F.col(c) for c in "abcd"]
    got = df.select(scoring.narrative_magnitude(*p, F.col("e")).alias("m"), scoring.narrative_status(*p).alias("s")).first()
    assert (round(got["m"], 2), got["s"]) == (magnitude, status)


@pytest.mark.parametrize("cur, prev, want", [(11, 3, "escalating"), (3, 0, "newly_material"), (0, 3, "diminishing"), (2, 3, "diminishing"), (4, 3, "stable"), (0, 0, "stable"), (3, 2, "escalating")])
def test_risk_status(spark, cur, prev, want):
    df = spark.createDataFrame([(cur, prev)], "a int, b int")
    assert df.select(scoring.risk_status(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize("mentions, mgmt, qual, points, want", [(11, True, 0, 7.0, "high"), (11, False, 0, 4.0, "medium"), (2, False, 1, 3.1, "low"), (1, True, 0, 3.8, "medium"), (5, True, 2, 10.0, "high")])
def test_risk_severity(spark, mentions, mgmt, qual, points, want):
    df = spark.createDataFrame([(mentions, mgmt, qual)], "a int, b boolean, c int")
    p = scoring.risk_severity_points(F.col("a"), F.col("b"), F.col("c"))
    got = df.select(F.round(p, 6).alias("p"), scoring.risk_severity(p).alias("s")).first()
    assert (got["p"], got["s"]) == (points, want)
