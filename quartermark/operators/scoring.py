"""The four signals' scores and classifications as Column expressions over features.

Ledgers are arrays of struct(label, delta); a score is the baseline plus the sum of the
deltas, clamped, and rounded once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp, py_round, ratio

# The constants of the scoring rules.
CONFIDENCE_BASE = 7.0
GUIDANCE_PRIOR, GUIDANCE_PRIOR_WEIGHT, IN_LINE_CREDIT = 0.5, 3.0, 0.8


def hedge_penalty(hedges: Column) -> Column:
    return -1.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), hedges - 5) / 10)


def ledger(items: list[tuple[str, Column, Column]]) -> Column:
    """Items (label, condition, delta) whose condition holds, in order."""
    entries = [F.when(cond, F.struct(F.lit(label).alias("label"), delta.cast("double").alias("delta"))) for label, cond, delta in items]
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def ledger_total(baseline: float | Column, items: Column) -> Column:
    return (baseline if isinstance(baseline, Column) else F.lit(baseline)) + F.aggregate(items, F.lit(0.0), lambda a, x: a + x["delta"])


def confidence_ledger(f: dict[str, Column]) -> Column:
    yes = F.lit(True)
    return ledger([
        ("tone", yes, 2.0 * f["tone"]),
        ("hedging", f["hedges"] > 5, hedge_penalty(f["hedges"])),
        ("defensive", f["defensive"] > 3, F.greatest(F.lit(-1.8), -0.6 * (f["defensive"] - 3))),
        ("wide_guidance", f["wide"], F.lit(-0.8)),
        ("superlatives", f["superlatives"] > 0, F.least(F.lit(0.8), 0.4 * f["superlatives"])),
        ("avoidance", f["avoidance"], F.lit(-1.0)),
    ])


def confidence_score(f: dict[str, Column], digits: int = 1) -> Column:
    return py_round(clamp(ledger_total(CONFIDENCE_BASE, confidence_ledger(f)), 0.0, 10.0), digits)


def reliability(evidence: Column, conflict: Column | None = None, spread: Column | None = None, widest: float = 0.5) -> Column:
    """How far a score is to be trusted: by the spread of an ensemble where there is one, else by the evidence."""
    by_evidence = F.when((evidence == 0) | (conflict if conflict is not None else F.lit(False)), "low").when(evidence < 3, "medium").otherwise("high")
    if spread is None:
        return by_evidence
    return F.when(spread.isNull(), by_evidence).when(spread <= widest / 2, "high").when(spread <= widest, "medium").otherwise("low")


def confidence_reliability(f: dict[str, Column], evidence: Column, spread: Column | None = None) -> Column:
    return reliability(evidence, (f["tone"] > 0.3) & (f["hedges"] > 12), spread)


def sub_dimensions(f: dict[str, Column]) -> dict[str, Column]:
    hp, dp = clamp((f["hedges"] - 5) / 10, 0.0, 1.0), clamp(f["defensive"] / 8, 0.0, 1.0)
    s, w = F.least(F.lit(2.0), 0.7 * f["superlatives"]), F.when(f["wide"], 2.0).otherwise(0.0)
    raw = {
        "level": 5 + 3 * f["tone"] - 4 * hp,
        "low_uncertainty": 10 - 7 * hp,
        "not_defensive": 10 - 7 * dp,
        "specificity": 6 - w + s,
        "consistency": 7 - w,
        "forward": 5 + 3 * f["tone"] + s,
    }
    return {k: py_round(clamp(v, 0.0, 10.0), 1) for k, v in raw.items()}


def tone_label(f: dict[str, Column]) -> Column:
    return (
        F.when((f["tone"] >= 0.3) & (f["hedges"] < 8), "bullish")
        .when((f["defensive"] >= 4) | (f["tone"] <= -0.2), "defensive")
        .when(f["hedges"] >= 8, "cautious")
        .otherwise("mixed")
    )


def drivers(items: Column, most: int = 4) -> Column:
    return F.slice(F.transform(F.filter(items, lambda x: F.abs(x["delta"]) > 1e-9), lambda x: x["label"]), 1, most)


def guidance_raw(beats: Column, in_line: Column, tracked: Column, streak: Column, hedged: Column | None = None, withdrew: Column | None = None) -> Column:
    """Unrounded 0-100 score; null when nothing was tracked (not assessed is never 0)."""
    no = F.lit(False)
    quality = (beats * 1.0 + in_line * IN_LINE_CREDIT + GUIDANCE_PRIOR_WEIGHT * GUIDANCE_PRIOR) / (tracked + GUIDANCE_PRIOR_WEIGHT)
    off = F.when(streak, 10.0).otherwise(0.0) + F.when(hedged if hedged is not None else no, 5.0).otherwise(0.0) + F.when(withdrew if withdrew is not None else no, 8.0).otherwise(0.0)
    return F.when(tracked > 0, clamp(100.0 * quality - off, 0.0, 100.0))


def guidance_score(*args, **kwargs) -> Column:
    return F.rint(guidance_raw(*args, **kwargs)).cast("int")


def guidance_without_history(specific: Column, hedged: Column, withdrew: Column) -> Column:
    raw = 50 + F.when(specific, 8).otherwise(0) - F.when(hedged, 8).otherwise(0) - F.when(withdrew, 15).otherwise(0)
    return clamp(raw, 35, 65)


def guidance_reliability(tracked: Column, evidence: Column, spread: Column | None = None) -> Column:
    base = reliability(evidence, None, spread)
    return F.when((tracked < 4) & (base == "high"), "medium").otherwise(base)


def guidance_ledger(streak: Column, hedged: Column, withdrew: Column) -> Column:
    """What is taken off a record of delivery; the record itself is the baseline and its item says so with no delta."""
    return ledger([
        ("track_record", F.lit(True), F.lit(0.0)),
        ("serial_miss_risk", streak, F.lit(-10.0)),
        ("hedged_guidance", hedged, F.lit(-5.0)),
        ("withdrew_guidance", withdrew, F.lit(-8.0)),
    ])


def guidance_language_ledger(specific: Column, hedged: Column, withdrew: Column) -> Column:
    """The items where there is no record, from a baseline of 50."""
    return ledger([
        ("specific_guidance", specific, F.lit(8.0)),
        ("hedged_guidance", hedged, F.lit(-8.0)),
        ("withdrew_guidance", withdrew, F.lit(-15.0)),
    ])


def guidance_baseline(beats: Column, in_line: Column, tracked: Column) -> Column:
    return 100.0 * (beats * 1.0 + in_line * IN_LINE_CREDIT + GUIDANCE_PRIOR_WEIGHT * GUIDANCE_PRIOR) / (tracked + GUIDANCE_PRIOR_WEIGHT)


def miss_streak(outcomes: Column) -> Column:
    """Two misses in a row anywhere in an array of outcomes."""
    pairs = F.zip_with(outcomes, F.slice(outcomes, 2, F.greatest(F.size(outcomes) - 1, F.lit(0))), lambda a, b: (a == "miss") & (b == "miss"))
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def theme_status(cur: Column, prev: Column, sentiment: Column, prev_sentiment: Column) -> Column:
    r = ratio(cur, prev, even_if_both_zero=True)
    return (
        F.when((sentiment <= -0.2) & (sentiment < prev_sentiment), "newly_risky")
        .when((prev <= 1) & (cur >= 2), "emerging")
        .when((cur == 0) | (r <= 0.5), "fading")
        .when((r >= 1.5) & (sentiment > 0), "accelerating")
        .otherwise("stable")
    )


def narrative_magnitude(cur: Column, prev: Column, sentiment: Column, prev_sentiment: Column, opening: Column) -> Column:
    r = ratio(cur, prev)
    freq = 0.6 * F.when((prev == 0) & (cur > 0), 0.6).otherwise(F.least(F.lit(1.0), F.abs(r - 1)))
    raw = freq + 0.3 * F.least(F.lit(1.0), F.abs(sentiment - prev_sentiment) / 0.5) + F.when(opening, 0.1).otherwise(0.0)
    return clamp(raw, 0.0, 1.0)


def narrative_status(cur: Column, prev: Column, sentiment: Column, prev_sentiment: Column) -> Column:
    r, moved = ratio(cur, prev), sentiment - prev_sentiment
    return (
        F.when((prev == 0) & (cur > 0), "new").when((cur == 0) & (prev > 0), "dropped")
        .when((r >= 1.5) | (moved >= 0.25), "accelerating").when(r >= 1.15, "building")
        .when((r <= 1 / 1.15) | (moved <= -0.25), "fading").otherwise("stable")
    )


def risk_status(cur: Column, prev: Column) -> Column:
    return (
        F.when((prev == 0) & (cur > 0), "newly_material").when((cur == 0) & (prev > 0), "diminishing")
        .when((prev > 0) & (cur * 2 >= prev * 3), "escalating").when((prev > 0) & (cur * 3 <= prev * 2), "diminishing").otherwise("stable")
    )


def risk_severity_points(mentions: Column, by_management: Column, qualifiers: Column) -> Column:
    return F.least(F.lit(4.0), 0.8 * mentions) + F.when(by_management, 3.0).otherwise(0.0) + F.least(F.lit(3.0), 1.5 * qualifiers)


def risk_severity(points: Column) -> Column:
    return F.when(points >= 7, "high").when(points >= 3.5, "medium").otherwise("low")


def live_severity(label: Column) -> Column:
    return F.when(F.lower(label).isin("low", "medium", "high", "critical"), F.lower(label)).otherwise("medium")


def severity_rank(label: Column) -> Column:
    return F.when(label == "critical", 3).when(label == "high", 2).when(label == "medium", 1).otherwise(0)


def overall_shift(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive > negative, "positive").when(negative > positive, "negative")
        .when(positive > 0, "mixed").otherwise("neutral")
    )


def risk_direction(up: Column, down: Column) -> Column:
    return F.when(up > down, "increasing").when(down > up, "decreasing").otherwise("stable")


def manifest(baseline: float | Column, items: Column, low: float, high: float) -> Column:
    baseline = baseline if isinstance(baseline, Column) else F.lit(baseline)
    raw = ledger_total(baseline, items)
    total = clamp(raw, low, high)
    return F.struct(baseline.alias("baseline"), raw.alias("raw_total"), total.alias("total"), F.array(F.lit(low), F.lit(high)).alias("range"), (raw != total).alias("clamped"), items.alias("items"))
