"""Signal rows from verified items: guidance, narrative and risk, with roll-ups and summaries.

Deltas against the period before are always computed here, from stored counts; none is
stored, so the order in which periods are scored does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..schemas import GUIDANCE_ITEM, RISK, THEME
from . import aggregates, compare, scoring

KEYS = ("ticker", "period_idx")


def guidance_signals(items: DataFrame, flags: DataFrame | None = None, keys=KEYS, order: str = "position") -> DataFrame:
    """Scores of a period's guidance items (keys, position, metric, outcome).

    ``flags`` (keys, hedged, withdrew) adjust the score. A period without tracked outcomes
    has a null score. Items of a period are few; they are ordered by ``position``.
    """
    packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("outcome")))), lambda x: x["outcome"])
    tracked = F.filter(packed, lambda o: o.isin("beat", "in_line", "miss"))
    rows = items.groupBy(*keys).agg(
        _listed(items, GUIDANCE_ITEM).alias("guidance_items"), tracked.alias("outcomes"), F.count_if(F.col("outcome") == "beat").alias("beats"), F.count_if(F.col("outcome") == "in_line").alias("in_line"),
        F.count_if(F.col("outcome") == "miss").alias("misses"), F.count_if(F.col("outcome") == "withdrew").alias("withdrawals"))
    serial = aggregates.serial_misses(items, list(keys)).groupBy(*keys).agg(F.array_sort(F.collect_set("metric")).alias("serial_miss_metrics"))
    rows = rows.join(serial, list(keys), "left").withColumn("serial_miss_metrics", F.coalesce("serial_miss_metrics", F.array().cast("array<string>")))
    if flags is None:
        rows = rows.withColumns({"hedged": F.lit(False), "withdrew": F.col("withdrawals") > 0})
    else:
        rows = rows.join(flags, list(keys), "left").fillna(False, ["hedged", "withdrew"])
    rows = aggregates.hit_rates(rows).withColumn("miss_streak", scoring.miss_streak(F.col("outcomes")))
    score = scoring.guidance_score(F.col("beats"), F.col("in_line"), F.col("tracked"), F.col("miss_streak"), F.col("hedged"), F.col("withdrew"))
    recent = F.slice("outcomes", F.greatest(F.size("outcomes") - 5, F.lit(1)), F.lit(6))
    items = scoring.guidance_ledger(F.col("miss_streak"), F.col("hedged"), F.col("withdrew"))
    base = scoring.guidance_baseline(F.col("beats"), F.col("in_line"), F.col("tracked"))
    rows = rows.withColumn("manifest", F.when(F.col("tracked") > 0, scoring.manifest(base, items, 0.0, 100.0)))
    rows = rows.withColumn("reliability", scoring.guidance_reliability(F.col("tracked"), F.col("tracked")))
    rows = rows.withColumns({"score": score, "serial_miss_risk": F.size("serial_miss_metrics") > 0, "recent_pattern": recent, "beat_rate": F.round(F.try_divide("beats", "tracked"), 3)})
    return rows.withColumn("summary", guidance_summary()).drop("outcomes")


def guidance_summary() -> Column:
    met = F.col("beats") + F.col("in_line")
    told = F.format_string(
        "Guidance credibility %d/100: %d of %d targets met (%.0f%%), %d beat, %d in line, %d missed.",
        F.col("score"), met, F.col("tracked"), F.coalesce(F.col("hit_rate"), F.lit(0.0)) * 100, F.col("beats"), F.col("in_line"), F.col("misses"))
    serial = F.when(F.col("serial_miss_risk"), F.concat(F.lit(" Missed repeatedly: "), F.array_join("serial_miss_metrics", ", "), F.lit("."))).otherwise("")
    return F.when(F.col("score").isNull(), "Guidance not assessed: no tracked outcome.").otherwise(F.concat(told, serial))


def _with_prior(current: DataFrame, name: str, columns, keys, threshold: float, stored: DataFrame | None = None) -> DataFrame:
    """Each name with the prior period's values under the same or a very similar name.

    ``stored`` rows (keys, name, position, columns) of other periods serve as baselines beside those of ``current``.
    """
    ticker, idx = keys
    facts = [name, "position", *columns]
    known = current.select(*keys, *facts)
    if stored is not None:
        known = known.unionByName(stored.join(current.select(*keys).distinct(), list(keys), "left_anti").select(*keys, *facts))
    prior = known.select(ticker, (F.col(idx) + 1).alias(idx), *facts)
    matched = compare.match_prior(current, prior, name, list(keys), "position", threshold)
    old = prior.select(*keys, F.col(name).alias("matched"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    periods = prior.select(*keys).distinct().withColumn("prior_available", F.lit(True))
    joined = matched.join(old, [*keys, "matched"], "left").join(periods, list(keys), "left")
    return joined.withColumn("prior_available", F.coalesce("prior_available", F.lit(False)))


def theme_table(themes: DataFrame, keys=KEYS, threshold: float = DEFAULT.fuzzy_threshold, stored: DataFrame | None = None) -> DataFrame:
    """Themes (keys, theme, position, cur, sentiment) with their baseline, changes and status."""
    t = _with_prior(themes, "theme", ["cur", "sentiment"], keys, threshold, stored).withColumns({
        "prev": F.coalesce("prev_cur", F.lit(0)), "prev_sentiment": F.coalesce("prev_sentiment", F.lit(0.0))}).drop("prev_cur")
    return t.withColumns({
        "count_change": F.col("cur") - F.col("prev"), "sentiment_change": F.round(F.col("sentiment") - F.col("prev_sentiment"), 3),
        "status": scoring.theme_status(F.col("cur"), F.col("prev"), F.col("sentiment"), F.col("prev_sentiment"))})


def _names(name: str, status: str) -> Column:
    packed = F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("position", name))))
    return F.transform(packed, lambda x: x[name]).alias(status)


def _listed(df: DataFrame, fields: dict[str, str]) -> Column:
    """A period's rows as structs of ``fields`` (name, type), in their order; what ``df`` lacks is null."""
    row = F.struct(*[(F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields.items()])
    return F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("row")))), lambda x: x["row"])


def quotes_of(quote: str = "quote", order: str = "position", most: int = 2, least: int = 15) -> Column:
    """An aggregate: the first ``most`` different quotes that have ``least`` characters once normalised."""
    from ..functions.text import normalize_quote

    good = F.when(F.length(normalize_quote(F.col(quote), False)) >= least, F.struct(order, quote))
    return F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(good)), lambda x: x[quote])), 1, most)


def _told(head: Column, parts: list[tuple[str, str]], otherwise: str) -> Column:
    said = F.filter(F.array(*[F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))) for label, c in parts]), lambda x: x.isNotNull())
    return F.concat(head, F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(otherwise), F.lit("."))


def narrative_signals(themes: DataFrame, keys=KEYS) -> DataFrame:
    """A row a period from ``theme_table`` rows: names by status, overall shift, summary."""
    rows = themes.groupBy(*keys).agg(
        *[_names("theme", s) for s in ("accelerating", "emerging", "fading", "newly_risky")], F.bool_or("prior_available").alias("prior_available"), _listed(themes, THEME).alias("themes"))
    up, down = F.size("accelerating") + F.size("emerging"), F.size("fading") + F.size("newly_risky")
    rows = rows.withColumn("overall_shift", scoring.overall_shift(up, down))
    head = F.concat(F.lit("The narrative shift is "), "overall_shift", F.lit(": "))
    parts = [("accelerating", "accelerating"), ("emerging", "emerging"), ("turning risky", "newly_risky"), ("fading", "fading")]
    return rows.withColumn("summary", _told(head, parts, "no theme moved materially"))


def risk_table(risks: DataFrame, keys=KEYS, threshold: float = DEFAULT.fuzzy_threshold, stored: DataFrame | None = None) -> DataFrame:
    """Risks (keys, risk, position, cur, severity) with their baseline and status."""
    t = _with_prior(risks, "risk", ["cur"], keys, threshold, stored).withColumn("prev", F.coalesce("prev_cur", F.lit(0))).drop("prev_cur")
    return t.withColumns({"severity": scoring.live_severity(F.col("severity")), "status": scoring.risk_status(F.col("cur"), F.col("prev"))})


def risk_signals(risks: DataFrame, keys=KEYS) -> DataFrame:
    rows = risks.groupBy(*keys).agg(
        *[_names("risk", s) for s in ("newly_material", "escalating", "diminishing", "resolved")],
        F.max_by("severity", scoring.severity_rank(F.col("severity"))).alias("worst_severity"), _listed(risks, RISK).alias("risks"))
    rows = rows.withColumn("diminishing", F.concat("diminishing", "resolved")).drop("resolved")
    up, down = F.size("newly_material") + F.size("escalating"), F.size("diminishing")
    rows = rows.withColumn("direction", scoring.risk_direction(up, down)).withColumnRenamed("newly_material", "new_risks")
    head = F.concat(F.lit("The risk profile is "), "direction", F.lit(": "))
    return rows.withColumn("summary", _told(head, [("new", "new_risks"), ("escalating", "escalating"), ("diminishing", "diminishing")], "no risk changed materially"))


def top_risks(risks: DataFrame, keys=KEYS, most: int = 5) -> DataFrame:
    """The gravest risks of a period, in their order of mention within a severity."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(scoring.severity_rank(F.col("severity")).desc(), "position")
    return risks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def key_quotes(items: DataFrame, evidence: DataFrame, keys=KEYS, most: int = 2, least: int = 15) -> DataFrame:
    """Items with ``key_quotes``: the first ``most`` of their quotes that the period's evidence contains.

    ``items`` have an id and an array ``quotes``; ``evidence`` is (keys, text), both
    normalised alike before they are compared.
    """
    from ..functions.text import normalize_quote

    asked = items.select("id", *keys, F.posexplode("quotes").alias("pos", "quote")).where(F.col("pos") < most)
    asked = asked.withColumn("__n", normalize_quote(F.col("quote"), False)).where(F.length("__n") >= least)
    texts = evidence.select(*keys, normalize_quote(F.col("text"), False).alias("__t"))
    hits = asked.join(texts, list(keys)).where(F.contains("__t", "__n")).select("id", "pos", "quote").distinct()
    kept = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "quote"))).alias("__q"))
    return items.join(kept, "id", "left").withColumn("key_quotes", F.coalesce(F.transform("__q", lambda x: x["quote"]), F.array().cast("array<string>"))).drop("__q")
