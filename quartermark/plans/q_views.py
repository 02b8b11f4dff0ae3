"""The public views under their own names, and the seams that only run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import SignalApi
from ..functions import text
from ..models import prompts, providers
from ..operators import chunking, pipeline, signals
from ..sources import pdf
from . import q_compare, q_scoring, q_store  # noqa: F401  whose queries are named again here
from .domain import ORACLES, PAYLOAD, QUERIES, announcements, kind, latest, lines, query, store_of, stored_sql, table, themes

# the same operators as these, which a view shows as they are
AGAIN = {"n12_theme_sentiment": "c09_theme_sentiment_table", "n17_quote_diagnosis": "c14_longest_prefix", "n18_run_cost": "a17_cost_ledger"}
for _new, _old in AGAIN.items():
    QUERIES[_new] = QUERIES[_old]
    if _old in ORACLES:
        ORACLES[_new] = ORACLES[_old]

K = ["ticker", "period_idx"]


def api_of(s, d, *kinds, **kw) -> SignalApi:
    return SignalApi(store_of(s, d, *kinds, **kw))


for _i, _name in enumerate(PAYLOAD):
    _columns = ", ".join(["id", "ticker", "quarter", "fiscal_year", *PAYLOAD[_name]])

    @query(f"n0{_i + 1}_{_name}_history", f"SELECT {_columns} FROM {stored_sql(_name)} WHERE ticker = '10' ORDER BY period_idx DESC, id LIMIT 8")
    def _(s, d, name=_name):
        return api_of(s, d, name).signal_history(name, "10", 8).select("id", "ticker", "quarter", "fiscal_year", *PAYLOAD[name])


@query("n05_source_documents", "SELECT doc_id::VARCHAR AS doc_id, quarter, fiscal_year, doc_type FROM docs WHERE ticker = 'src1' AND quarter = 'Q2' ORDER BY fiscal_year DESC, quarter DESC, doc_id::VARCHAR LIMIT 20")
def _(s, d):
    return api_of(s, d, documents=True).documents("src1", "Q2", limit=20).select("doc_id", "quarter", "fiscal_year", "doc_type")


@query("n06_document_text", "SELECT doc_id::VARCHAR AS doc_id, md5(substr(text, 1, 60000)) AS text_md5 FROM docs WHERE doc_id = 42")
def _(s, d):
    return api_of(s, d, documents=True).document_text("42").select("doc_id", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


@query("n07_period_bundle", f"""SELECT c.ticker, c.period_idx, c.score AS confidence, n.overall_shift AS shift, g.score AS guidance, r.direction FROM {stored_sql("confidence")} c
LEFT JOIN {stored_sql("narrative")} n ON n.ticker = c.ticker AND n.period_idx = c.period_idx LEFT JOIN {stored_sql("guidance")} g ON g.ticker = c.ticker AND g.period_idx = c.period_idx
LEFT JOIN {stored_sql("risk")} r ON r.ticker = c.ticker AND r.period_idx = c.period_idx WHERE c.ticker = '10'""")
def _(s, d):
    b = api_of(s, d, *PAYLOAD).bundles("10")
    return b.select(*K, F.col("score").alias("confidence"), F.col("narrative.overall_shift").alias("shift"), F.col("guidance.score").alias("guidance"), F.col("risk.direction").alias("direction"))


@query("n08_ytd_guidance", f"""SELECT ticker, fiscal_year, sum(beats)::BIGINT AS beats, sum(in_line)::BIGINT AS in_line, sum(misses)::BIGINT AS misses, string_agg(DISTINCT quarter, ',' ORDER BY quarter) AS quarters,
round((sum(beats) + sum(in_line))::DOUBLE / nullif(sum(beats + in_line + misses), 0), 4) AS hit_rate FROM {stored_sql("guidance")} WHERE ticker = '10' GROUP BY 1, 2""")
def _(s, d):
    y = api_of(s, d, "guidance").ytd_guidance("10")
    return y.select("ticker", "fiscal_year", "beats", "in_line", "misses", F.array_join("quarters", ",").alias("quarters"), F.round("hit_rate", 4).alias("hit_rate"))


@query("n08_ytd_risks", f"""WITH r AS (SELECT * FROM {stored_sql("risk")} WHERE ticker = '10'), seen AS (SELECT fiscal_year, status, min(quarter) AS q FROM r GROUP BY 1, 2)
SELECT '10' AS ticker, fiscal_year, string_agg(status, ',' ORDER BY q, status) AS new_risks, 'fx' AS escalating, '' AS active FROM seen GROUP BY fiscal_year""")
def _(s, d):
    y = api_of(s, d, "risk").ytd_risks("10")
    return y.select("ticker", "fiscal_year", F.array_join("new", ",").alias("new_risks"), F.array_join("escalating", ",").alias("escalating"), F.array_join("active", ",").alias("active"))


@query("n11_recomputed_shift", ORACLES["c08_recomputed_shift"])
def _(s, d):
    """The shift recomputed from stored theme counts, each theme against its name in the quarter before."""
    t = signals.theme_table(themes(s, d).withColumn("position", F.xxhash64("theme")))
    n = signals.narrative_signals(t)
    size = {c: F.size(c) for c in ("accelerating", "emerging", "fading", "newly_risky")}
    return n.select(*K, (size["accelerating"] + size["emerging"]).cast("long").alias("pos"), (size["fading"] + size["newly_risky"]).cast("long").alias("neg"), F.col("overall_shift").alias("shift"))


@query("n13_trend_with_deltas", f"""WITH c AS (SELECT * FROM {stored_sql("confidence")} WHERE ticker = '10') SELECT a.ticker, a.quarter || ' FY' || lpad((a.fiscal_year % 100)::VARCHAR, 2, '0') AS label, a.score, round(a.score - b.score, 6) AS score_delta,
row_number() OVER (ORDER BY a.period_idx) AS place FROM c a LEFT JOIN c b ON b.period_idx = a.period_idx - 1""")
def _(s, d):
    """The trend series of a ticker: label, score and change of each period, with its place."""
    from pyspark.sql import Window

    rows = api_of(s, d, "confidence").all_periods("10")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("period_idx")).cast("long")
    return rows.select("ticker", "label", "score", F.round("score_delta", 6).alias("score_delta"), place.alias("place"))



@query("h36_score_transition", "SELECT doc_id, pos, contains(line, 'A') AS told FROM lines")
def _(s, d):
    from ..operators.validate import narrated_priors

    t = lines(s, d).select("doc_id", "pos", F.when(F.contains("line", F.lit("A")), "The score fell from 7 to 6.5 again.").otherwise("The score is 7. Sales fell from 9 to 8.").alias("summary"))
    hits = narrated_priors(t).select("doc_id", "pos", F.lit(True).alias("told"))
    return t.select("doc_id", "pos").join(hits, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("told", F.lit(False)).alias("told"))


@query("n20_evidence_panel", "SELECT ticker, period_idx, string_agg(chunk_id, ',' ORDER BY doc_id, pos) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_idx ORDER BY doc_id, pos) AS n FROM lines WHERE contains(line, ',')) WHERE n <= 2 GROUP BY 1, 2")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*K).orderBy("doc_id", "pos")
    top = lines(s, d).where(F.contains("line", F.lit(","))).withColumn("n", F.row_number().over(w)).where("n <= 2")
    g = top.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("p"))
    return g.select(*K, F.array_join(F.transform("p", lambda x: x["chunk_id"]), ",").alias("quotes"))


@query("a15_bundle_json", """SELECT id, '{"id":' || id || ',"quarter":"' || quarter || '","fiscal_year":' || fiscal_year || ',"note":null}' AS json FROM latest""")
def _(s, d):
    row = F.struct("id", "quarter", "fiscal_year", F.lit(None).cast("string").alias("note"))
    return latest(s, d).select("id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


@query("i20_key_quotes", "SELECT item_id AS id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS verbatim FROM benchmark b WHERE length(b.text) > 0")
def _(s, d):
    from ..operators.compare import contained

    b = table(s, d, "benchmark").where(F.length("text") > 0)
    hits = contained(b, "text", table(s, d, "documents").select("doc_id", "text"), "text", "item_id", "doc_id").select(F.col("item_id").alias("id")).distinct().withColumn("verbatim", F.lit(True))
    return b.select(F.col("item_id").alias("id")).join(hits, "id", "left").select("id", F.coalesce("verbatim", F.lit(False)).alias("verbatim"))


@query("f09_speaker_blocks")
def _(s, d):
    """Turns of conversations as speaker blocks of one text each."""
    c = table(s, d, "conversations")
    said = F.format_string("%s: %s", F.initcap("role"), "text")
    talk = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("line")))), lambda x: x["line"]), "\n").alias("raw_text"))
    rows = talk.select(F.col("conv_id").cast("string").alias("doc_id"), *[F.lit("").alias(n) for n in ("ticker", "company", "doc_type", "quarter")], F.lit(2026).alias("fiscal_year"),
                       F.lit(None).cast("timestamp_ntz").alias("event_date"), F.lit("").alias("source_url"), F.lit("").alias("title"), "raw_text")
    return chunking.chunk_documents(rows).groupBy("speaker", "is_management").agg(F.count("*").alias("n"))


@query("e11_table_row_groups")
def _(s, d):
    """Parts as one long pipe table a brand, split into row groups under its header."""
    p = table(s, d, "part")
    row = F.format_string("| %s | %s | %d |", "p_name", "p_type", "p_partkey")
    t = p.groupBy("p_brand").agg(F.concat(F.lit("| name | type | key |\n|---|---|---|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("line")))), lambda x: x["line"]), "\n")).alias("raw_text"))
    rows = t.select(F.col("p_brand").alias("doc_id"), *[F.lit("").alias(n) for n in ("ticker", "company", "doc_type", "quarter")], F.lit(2026).alias("fiscal_year"),
                    F.lit(None).cast("timestamp_ntz").alias("event_date"), F.lit("").alias("source_url"), F.lit("Parts").alias("title"), "raw_text")
    return chunking.chunk_documents(rows).groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(F.length("text")).alias("longest"))


@query("k02_model_payloads")
def _(s, d):
    """Prompts over evidence, completed offline and parsed."""
    from ..functions import jsonfn

    b = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit(prompts.system_prompt("confidence")).alias("system"),
                                        prompts.user_prompt(F.lit("Company"), F.lit("Q1 FY26"), F.col("text")).alias("user"))
    return providers.complete(b).select("id", "ok", jsonfn.payload(F.col("payload"), "words int, hedging_markers int").alias("p")).select("id", "ok", "p.words", "p.hedging_markers")


@query("k05_tone", "SELECT id, CASE WHEN wide THEN 1.0 WHEN avoidance THEN -1.0 ELSE 0.0 END::DOUBLE AS tone FROM latest")
def _(s, d):
    label = F.when(F.col("wide"), "Positive").when(F.col("avoidance"), "cautious").otherwise("flat")
    return latest(s, d).select("id", providers.tone_value(label).alias("tone"))


@query("k06_extractor")
def _(s, d):
    pdf.bounded(s)
    p = table(s, d, "pages").select("page_id", pdf.extract(F.encode("html", "utf-8")).alias("r"))
    return p.groupBy("r.how").agg(F.count("*").alias("n"))


@query("k07_narration")
def _(s, d):
    t = signals.theme_table(themes(s, d).withColumn("position", F.xxhash64("theme")))
    n = signals.narrative_signals(t)
    facts = n.select(F.concat_ws("::", F.col("ticker").cast("string"), F.col("period_idx").cast("string")).alias("id"), F.col("overall_shift").alias("headline"), F.array("summary").alias("drivers"), F.col("summary").alias("fallback"))
    return providers.narrate(facts, s.createDataFrame([], "fingerprint string, prose string")).select("id", "prose", "cached")


@query("l02_fetch_one_period")
def _(s, d):
    wanted = s.createDataFrame([(8070, 0)], "period_idx int, ordinal int")
    a = announcements(s, d).withColumn("urls", F.array("url")).drop("url", "ticker", "source")
    texts = announcements(s, d).select("url", F.concat(F.lit("Filed: "), F.repeat("url", 20)).alias("text")).dropDuplicates(["url"])
    return pipeline.fetch(a, wanted, texts, "TCK", "Company").select("doc_id", "doc_type", "quarter", "fiscal_year", "source_url")


@query("l04_markable_periods", "SELECT ticker, quarter, fiscal_year FROM latest WHERE status = 'F' AND NOT wide")
def _(s, d):
    t = latest(s, d)
    made = {"confidence": t, "narrative": kind(t, 1), "guidance": kind(t, 2), "risk": t}
    return pipeline.markable(made, t.where("wide"))


@query("l08_late_filings", "SELECT count(*) AS n FROM (SELECT DISTINCT url FROM annp WHERE doc_type IS NOT NULL AND event_date IS NOT NULL)")
def _(s, d):
    """What the filing stream keeps, as a batch: classified filings, each URL once."""
    rows = announcements(s, d).withColumn("doc_type", text.classify(F.col("subject"))).where("doc_type is not null and event_date is not null")
    return rows.select("url").distinct().agg(F.count("*").alias("n"))


@query("n19_signal_summary", f"""WITH c AS (SELECT a.*, a.score - b.score AS change FROM {stored_sql("confidence")} a LEFT JOIN {stored_sql("confidence")} b ON b.ticker = a.ticker AND b.period_idx = a.period_idx - 1)
SELECT ticker, quarter, fiscal_year, period_idx, 'Management Confidence' AS signal, printf('%.1f/10', score) || coalesce(printf(' (%+.1f QoQ)', change), '') AS status, CASE WHEN score >= 7 THEN 'green' WHEN score >= 5 THEN 'yellow' ELSE 'red' END AS band, summary AS finding FROM c
UNION ALL SELECT ticker, quarter, fiscal_year, period_idx, 'Narrative Shift', upper(overall_shift), CASE overall_shift WHEN 'positive' THEN 'green' WHEN 'mixed' THEN 'yellow' ELSE 'dim' END, summary FROM {stored_sql("narrative")}
UNION ALL SELECT ticker, quarter, fiscal_year, period_idx, 'Guidance Credibility', printf('%.0f/100', score), CASE WHEN score >= 70 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END, summary FROM {stored_sql("guidance")}
UNION ALL SELECT ticker, quarter, fiscal_year, period_idx, 'Risk Emergence', upper(direction), CASE direction WHEN 'increasing' THEN 'red' ELSE 'yellow' END, '1 new · 1 escalating — ' || summary || '…' FROM {stored_sql("risk")}""")
def _(s, d):
    """All four signals of every company and period as the bundle's table shows them."""
    return api_of(s, d, *PAYLOAD).summary_table()
