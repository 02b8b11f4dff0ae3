"""Scores, statuses and their parts over features of periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import scoring
from .domain import guidance, latest, query, signals, theme_pairs

FEATURES = ("tone", "hedges", "defensive", "superlatives", "wide", "avoidance")
K = ["ticker", "period_idx"]


def f():
    return {c: F.col(c) for c in FEATURES}


HEDGE = "-1.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, hedges - 5) / 10)"
DELTAS = [
    ("tone", "TRUE", "2.0::DOUBLE * tone"), ("hedging", "hedges > 5", HEDGE), ("defensive", "defensive > 3", "greatest(-1.8::DOUBLE, -0.6::DOUBLE * (defensive - 3))"),
    ("wide_guidance", "wide", "-0.8::DOUBLE"), ("superlatives", "superlatives > 0", "least(0.8::DOUBLE, 0.4::DOUBLE * superlatives)"), ("avoidance", "avoidance", "-1.0::DOUBLE"),
]
SUM = " + ".join(f"CASE WHEN {c} THEN {x} ELSE 0 END" for _, c, x in DELTAS)
CONFIDENCE = f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, 7.0::DOUBLE + ({SUM})))"


@query("i01_confidence_score", f"SELECT id, round({CONFIDENCE}, 6) AS score FROM sig")
def _(s, d):
    raw = numbers.clamp(scoring.ledger_total(scoring.CONFIDENCE_BASE, scoring.confidence_ledger(f())), 0.0, 10.0)
    return signals(s, d).select("id", F.round(raw, 6).alias("score"))


@query("d19_ledger_fold", f"SELECT id, round(7.0::DOUBLE + ({SUM}), 6) AS raw_total, round(7.0::DOUBLE + ({SUM}), 6) NOT BETWEEN 0 AND 10 AS clamped FROM sig")
def _(s, d):
    m = scoring.manifest(scoring.CONFIDENCE_BASE, scoring.confidence_ledger(f()), 0.0, 10.0)
    return signals(s, d).select("id", m.alias("m")).select("id", F.round("m.raw_total", 6).alias("raw_total"), (~F.round("m.raw_total", 6).between(0, 10)).alias("clamped"))


@query("i02_reliability", "SELECT id, CASE WHEN evidence = 0 OR (tone > 0.3::DOUBLE AND hedges > 12) THEN 'low' WHEN evidence < 3 THEN 'medium' ELSE 'high' END AS reliability FROM sig")
def _(s, d):
    return signals(s, d).select("id", scoring.confidence_reliability(f(), F.col("evidence")).alias("reliability"))


@query("i03_sub_dimensions", """WITH x AS (SELECT id, tone, greatest(0::DOUBLE, least(1::DOUBLE, (hedges - 5) / 10)) AS hp, greatest(0::DOUBLE, least(1::DOUBLE, defensive::DOUBLE / 8)) AS dp, least(2::DOUBLE, 0.7::DOUBLE * superlatives) AS s, CASE WHEN wide THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM sig)
SELECT id, abs(round(greatest(0, least(10, 5 + 3 * tone - 4 * hp)), 6)) AS level, round(10 - 7 * hp, 6) AS low_uncertainty, round(10 - 7 * dp, 6) AS not_defensive, round(6 - w + s, 6) AS specificity, round(7 - w, 6) AS consistency, round(greatest(0, least(10, 5 + 3 * tone + s)), 6) AS forward FROM x""")
def _(s, d):
    c = f()
    hp, dp = numbers.clamp((c["hedges"] - 5) / 10, 0.0, 1.0), numbers.clamp(c["defensive"] / 8, 0.0, 1.0)
    sup, w = F.least(F.lit(2.0), 0.7 * c["superlatives"]), F.when(c["wide"], 2.0).otherwise(0.0)
    raw = {"level": 5 + 3 * c["tone"] - 4 * hp, "low_uncertainty": 10 - 7 * hp, "not_defensive": 10 - 7 * dp, "specificity": 6 - w + sup, "consistency": 7 - w, "forward": 5 + 3 * c["tone"] + sup}
    return signals(s, d).select("id", *[F.abs(F.round(numbers.clamp(v, 0.0, 10.0), 6)).alias(k) for k, v in raw.items()])


@query("i03_sub_dimensions_rounded")
def _(s, d):
    return signals(s, d).select("id", *[v.alias(k) for k, v in scoring.sub_dimensions(f()).items()])


@query("i04_tone_label", "SELECT id, CASE WHEN tone >= 0.3::DOUBLE AND hedges < 8 THEN 'bullish' WHEN defensive >= 4 OR tone <= -0.2::DOUBLE THEN 'defensive' WHEN hedges >= 8 THEN 'cautious' ELSE 'mixed' END AS label FROM sig")
def _(s, d):
    return signals(s, d).select("id", scoring.tone_label(f()).alias("label"))


PARTS = ", ".join(f"CASE WHEN {c} AND abs({x}) > 1e-9 THEN '{n}' END" for n, c, x in DELTAS)


@query("i05_drivers", f"SELECT id, coalesce(array_to_string(list_slice(list_filter([{PARTS}], lambda x: x IS NOT NULL), 1, 4), ','), '') AS drivers FROM sig")
def _(s, d):
    return signals(s, d).select("id", F.array_join(scoring.drivers(scoring.confidence_ledger(f())), ",").alias("drivers"))


GUIDE = "greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE * ((beats * 1.0::DOUBLE + in_line * 0.8::DOUBLE + 1.5::DOUBLE) / (tracked + 3.0::DOUBLE)) - CASE WHEN streak THEN 10 ELSE 0 END))"


@query("i06_guidance_score", f"SELECT ticker, period_idx, round({GUIDE}, 6) AS score FROM guid")
def _(s, d):
    raw = scoring.guidance_raw(*[F.col(c) for c in ("beats", "in_line", "tracked", "streak")])
    return guidance(s, d).select(*K, F.round(raw, 6).alias("score"))


@query("i06_guidance_score_whole")
def _(s, d):
    return guidance(s, d).select(*K, scoring.guidance_score(*[F.col(c) for c in ("beats", "in_line", "tracked", "streak")], hedged=F.col("ticker") % 3 == 0, withdrew=F.col("ticker") % 4 == 0).alias("score"))


@query("i07_guidance_without_history", "SELECT id, greatest(35, least(65, 50 + CASE WHEN wide THEN 0 ELSE 8 END - CASE WHEN hedges > 8 THEN 8 ELSE 0 END - CASE WHEN avoidance THEN 15 ELSE 0 END))::INT AS score FROM sig")
def _(s, d):
    return signals(s, d).select("id", scoring.guidance_without_history(~F.col("wide"), F.col("hedges") > 8, F.col("avoidance")).alias("score"))


@query("i08_guidance_reliability", "SELECT ticker, period_idx, CASE WHEN beats = 0 THEN 'low' WHEN beats < 3 THEN 'medium' WHEN tracked < 4 THEN 'medium' ELSE 'high' END AS reliability FROM guid")
def _(s, d):
    return guidance(s, d).select(*K, scoring.guidance_reliability(F.col("tracked"), F.col("beats")).alias("reliability"))


@query("i09_not_assessed", f"SELECT ticker, period_idx, CASE WHEN tracked - in_line > 0 THEN round({GUIDE.replace('tracked', '(tracked - in_line)').replace('in_line * 0.8::DOUBLE', '0')}, 6) END AS score FROM guid".replace("(tracked - 0)", "(tracked - in_line)"))
def _(s, d):
    raw = scoring.guidance_raw(F.col("beats"), F.lit(0), F.col("tracked") - F.col("in_line"), F.col("streak"))
    return guidance(s, d).select(*K, F.round(raw, 6).alias("score"))


STATUS = """CASE WHEN sentiment <= -0.2::DOUBLE AND sentiment < prev_sentiment THEN 'newly_risky' WHEN prev <= 1 AND cur >= 2 THEN 'emerging' WHEN cur = 0 OR (prev > 0 AND cur::DOUBLE / prev <= 0.5) THEN 'fading' WHEN (prev <= 0 OR cur::DOUBLE / prev >= 1.5) AND sentiment > 0 THEN 'accelerating' ELSE 'stable' END"""
PAIR = ("cur", "prev", "sentiment", "prev_sentiment")


@query("i10_theme_status", f"SELECT ticker, period_idx, theme, {STATUS} AS status FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select(*K, "theme", scoring.theme_status(*[F.col(c) for c in PAIR]).alias("status"))


@query("i11_narrative_magnitude", """SELECT ticker, period_idx, theme, round(greatest(0, least(1, 0.6::DOUBLE * CASE WHEN prev = 0 THEN 0.6::DOUBLE ELSE least(1::DOUBLE, abs(cur::DOUBLE / prev - 1)) END + 0.3::DOUBLE * least(1::DOUBLE, abs(sentiment - prev_sentiment) / 0.5::DOUBLE) + CASE WHEN ticker % 2 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)), 6) AS magnitude,
CASE WHEN prev = 0 THEN 'new' WHEN cur::DOUBLE / prev >= 1.5 OR sentiment - prev_sentiment >= 0.25::DOUBLE THEN 'accelerating' WHEN cur::DOUBLE / prev >= 1.15::DOUBLE THEN 'building' WHEN cur::DOUBLE / prev <= 1 / 1.15::DOUBLE OR sentiment - prev_sentiment <= -0.25::DOUBLE THEN 'fading' ELSE 'stable' END AS status FROM pairs""")
def _(s, d):
    p = [F.col(c) for c in PAIR]
    return theme_pairs(s, d).select(*K, "theme", F.round(scoring.narrative_magnitude(*p, F.col("ticker") % 2 == 0), 6).alias("magnitude"), scoring.narrative_status(*p).alias("status"))


@query("i12_risk_status", "SELECT ticker, period_idx, theme, CASE WHEN prev = 0 THEN 'newly_material' WHEN cur * 2 >= prev * 3 THEN 'escalating' WHEN cur * 3 <= prev * 2 THEN 'diminishing' ELSE 'stable' END AS status FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select(*K, "theme", scoring.risk_status(F.col("cur"), F.col("prev")).alias("status"))


@query("i13_risk_severity", """WITH p AS (SELECT id, least(4::DOUBLE, 0.8::DOUBLE * defensive) + CASE WHEN wide THEN 3 ELSE 0 END + least(3::DOUBLE, 1.5::DOUBLE * superlatives) AS points FROM sig) SELECT id, round(points, 6) AS points, CASE WHEN points >= 7 THEN 'high' WHEN points >= 3.5 THEN 'medium' ELSE 'low' END AS severity FROM p""")
def _(s, d):
    points = scoring.risk_severity_points(F.col("defensive"), F.col("wide"), F.col("superlatives"))
    return signals(s, d).select("id", F.round(points, 6).alias("points"), scoring.risk_severity(points).alias("severity"))


@query("i14_live_severity", "SELECT id, CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity FROM sig")
def _(s, d):
    label = F.when(F.col("id") % 4 == 0, "HIGH").when(F.col("id") % 4 == 1, "low").when(F.col("id") % 4 == 2, "severe")
    return signals(s, d).select("id", scoring.live_severity(label).alias("severity"))


@query("i15_manifest")
def _(s, d):
    m = scoring.manifest(scoring.CONFIDENCE_BASE, scoring.confidence_ledger(f()), 0.0, 10.0)
    return signals(s, d).select("id", F.to_json(m).alias("manifest"))


@query("i16_guidance_summary", """SELECT ticker, period_idx, 'Hit ' || (beats + in_line) || ' of ' || tracked || ' guidance targets: ' || beats || ' beat, ' || in_line || ' in-line, ' || misses || ' miss.' || CASE WHEN streak THEN ' Two misses in a row.' ELSE '' END AS summary FROM guid""")
def _(s, d):
    told = F.format_string("Hit %d of %d guidance targets: %d beat, %d in-line, %d miss.", F.col("beats") + F.col("in_line"), "tracked", "beats", "in_line", "misses")
    return guidance(s, d).select(*K, F.concat(told, F.when(F.col("streak"), " Two misses in a row.").otherwise("")).alias("summary"))


@query("i17_build_features", """SELECT ticker, round(avg(tone), 6) AS tone, count_if(hedges > 10)::BIGINT AS n_hedges, count_if(defensive > 5)::BIGINT AS defensive, bool_or(wide) AS wide, count(*) AS evidence FROM sig GROUP BY ticker""")
def _(s, d):
    return signals(s, d).groupBy("ticker").agg(F.round(F.avg("tone"), 6).alias("tone"), F.count_if(F.col("hedges") > 10).alias("n_hedges"), F.count_if(F.col("defensive") > 5).alias("defensive"), F.bool_or("wide").alias("wide"), F.count("*").alias("evidence"))


@query("i18_attach_prior", "SELECT ticker, period_idx, theme, cur, prev FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select(*K, "theme", "cur", "prev")


@query("i19_theme_changes", "SELECT ticker, period_idx, theme, cur - prev AS count_change, round(sentiment - prev_sentiment, 6) AS sentiment_change FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select(*K, "theme", (F.col("cur") - F.col("prev")).alias("count_change"), F.round(F.col("sentiment") - F.col("prev_sentiment"), 6).alias("sentiment_change"))


@query("i21_one_pass", f"""SELECT l.ticker, l.period_idx, round({CONFIDENCE}, 6) AS confidence, g.score AS guidance FROM latest l LEFT JOIN (SELECT ticker, period_idx, round({GUIDE}, 6) AS score FROM guid) g ON g.ticker = l.ticker AND g.period_idx = l.period_idx""")
def _(s, d):
    raw = numbers.clamp(scoring.ledger_total(scoring.CONFIDENCE_BASE, scoring.confidence_ledger(f())), 0.0, 10.0)
    g = guidance(s, d).select(*K, F.round(scoring.guidance_raw(*[F.col(c) for c in ("beats", "in_line", "tracked", "streak")]), 6).alias("guidance"))
    return latest(s, d).select(*K, F.round(raw, 6).alias("confidence")).join(g, K, "left")


@query("n19_score_bands", "SELECT id, CASE WHEN score >= 7 THEN 'strong' WHEN score >= 5 THEN 'fair' ELSE 'weak' END AS band FROM latest")
def _(s, d):
    return latest(s, d).select("id", F.when(F.col("score") >= 7, "strong").when(F.col("score") >= 5, "fair").otherwise("weak").alias("band"))
