"""Sources, store reads, mutations, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods, text
from ..models import providers
from ..operators import aggregates, compare, store
from ..sources import announcements as ann_source
from ..sources import caches, pdf
from .domain import LINE, PAYLOAD, announcements, docs, guidance, items, kind, kind_sql, latest, lines, query, signals, store_of, stored_sql, table

P = ["ticker", "quarter", "fiscal_year"]


def sort_key(c):
    return F.col(c).asc_nulls_last()


# --- A: sources -------------------------------------------------------------------------

@query("a03_nse_fields", """SELECT 'NSE' AS source, trim(subject || ' filed') AS subject, url, event_date FROM ann WHERE source = 'NSE'""")
def _(s, d):
    raw = announcements(s, d).where("source = 'NSE'").select(
        F.col("subject").alias("desc"), F.lit("filed").alias("attchmntText"), F.col("url").alias("attchmntFile"), F.date_format("event_date", "dd-MMM-yyyy HH:mm:ss").alias("an_dt"))
    return ann_source.nse_rows(raw).select("source", "subject", F.get("urls", F.lit(0)).alias("url"), "event_date")


@query("a04_bse_fields", """SELECT 'BSE' AS source, trim(subject) AS subject, 'https://a/' || url AS url1, 'https://b/' || url AS url2, event_date FROM ann WHERE source = 'BSE'""")
def _(s, d):
    raw = announcements(s, d).where("source = 'BSE'").select(
        F.col("subject").alias("HEADLINE"), F.lit("").alias("NEWSSUB"), F.col("url").alias("ATTACHMENTNAME"), F.lit("no date").alias("NEWS_DT"),
        F.date_format("event_date", "yyyy-MM-dd'T'HH:mm:ss").alias("DT_TM"))
    rows = ann_source.bse_rows(raw, ("https://a/", "https://b/"))
    return rows.select("source", "subject", F.get("urls", F.lit(0)).alias("url1"), F.get("urls", F.lit(1)).alias("url2"), "event_date")


@query("a05_source_union", "SELECT source, count(*) AS n, count(event_date) AS dated FROM ann GROUP BY source")
def _(s, d):
    a = announcements(s, d)
    return a.where("source = 'NSE'").unionByName(a.where("source = 'BSE'")).groupBy("source").agg(F.count("*").alias("n"), F.count("event_date").alias("dated"))


@query("a06_scrip_resolve", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'X' || c_custkey END, CASE c_custkey % 3 WHEN 0 THEN '500209' WHEN 1 THEN '532540' END, CASE WHEN c_acctbal > 0 THEN 'F' END) AS scrip FROM customer""")
def _(s, d):
    c = table(s, d, "customer")
    symbol = F.when(F.col("c_custkey") % 3 == 0, "infy").when(F.col("c_custkey") % 3 == 1, "TCS").otherwise("none")
    rows = c.select("c_custkey", "c_acctbal", symbol.alias("symbol"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("X"), F.col("c_custkey").cast("string"))).alias("scrip"))
    return ann_source.scrip_codes(rows, lookup=lambda _: F.when(F.col("c_acctbal") > 0, "F")).select("c_custkey", F.col("resolved").alias("scrip"))


@query("a09_parser_gates", """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_size <= 40 THEN 'rich' ELSE 'plain' END AS parser, CASE WHEN p_partkey % 3 <> 0 AND p_size <= 40 THEN least(p_size, 25) ELSE p_size END AS pages FROM part""")
def _(s, d):
    p = table(s, d, "part")
    types = F.when(F.col("p_partkey") % 3 == 0, "news_article").when(F.col("p_partkey") % 3 == 1, "annual_report").otherwise("earnings_call")
    return p.select("p_partkey", pdf.route(types, F.col("p_size"), ("annual_report", "earnings_call"), 40, 25).alias("r")).select("p_partkey", "r.parser", "r.pages")


@query("a10_parse_cache", """WITH keyed AS (SELECT page_id, url, substr(sha256(url), 1, 32) AS k FROM pages)
SELECT page_id, k AS cache_key, contains(url, '/en/') AND NOT contains(url, 'blog') AS hit FROM keyed""")
def _(s, d):
    p = table(s, d, "pages")
    old = p.where(F.contains("url", F.lit("/en/"))).select(text.sha_key(F.col("url"), 32).alias("cache_key"), F.when(F.contains("url", F.lit("blog")), "v1").otherwise("v2").alias("version"), F.lit(25).alias("page_limit"), F.lit("t").alias("text"))
    hits, misses = caches.split_hits(p.select("page_id", "url"), old, "v2", 25)
    return hits.select("page_id", "cache_key", F.lit(True).alias("hit")).union(misses.select("page_id", "cache_key", F.lit(False)))


@query("a12_cache_stats", "SELECT count(*) AS entries, coalesce(sum(octet_length(encode(html))), 0)::BIGINT AS bytes FROM pages")
def _(s, d):
    return caches.stats(table(s, d, "pages"), "html")


@query("a16_narration_cache", """SELECT id, CASE WHEN wide THEN 'cached ' || id ELSE 'plain' END AS prose, wide AS cached FROM sig""")
def _(s, d):
    facts = signals(s, d).select("id", "wide", F.concat(F.lit("score "), F.col("id").cast("string")).alias("headline"), F.array(F.lit("tone")).alias("drivers"), F.lit("plain").alias("fallback"))
    key = F.substring(F.sha2(F.to_json(F.struct("drivers", "headline", F.lit("1").alias("v"))).cast("binary"), 256), 1, 16)
    cache = facts.where("wide").select(key.alias("fingerprint"), F.concat(F.lit("cached "), F.col("id").cast("string")).alias("prose"))
    return providers.narrate(facts, cache).select("id", "prose", "cached")


CALLS = """SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE l_linenumber % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini-2024' WHEN 2 THEN 'gpt-4o-2024' ELSE 'other' END AS model, l_quantity::BIGINT * 100 AS tokens_in, l_linenumber * 10 AS tokens_out FROM lineitem"""


def calls(s, d):
    n = F.col("l_linenumber")
    model = F.when(n % 4 == 0, "gpt-4o").when(n % 4 == 1, "gpt-4o-mini-2024").when(n % 4 == 2, "gpt-4o-2024").otherwise("other")
    c = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("call_id"), model.alias("model"), (F.col("l_quantity").cast("long") * 100).alias("tokens_in"), (n * 10).alias("tokens_out"))
    prices = s.createDataFrame([(m, *p) for m, p in providers.PRICES.items()], "model string, price_in double, price_out double")
    return providers.price_join(c, prices)


@query("a17_cost_ledger", f"""WITH calls AS ({CALLS}), priced AS (SELECT *, CASE WHEN model LIKE 'gpt-4o-mini%' THEN 0.15 WHEN model LIKE 'gpt-4o%' THEN 2.5 END AS pi, CASE WHEN model LIKE 'gpt-4o-mini%' THEN 0.6 WHEN model LIKE 'gpt-4o%' THEN 10 END AS po FROM calls)
SELECT count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum((tokens_in * pi + tokens_out * po)::DOUBLE) / 1e6, 4) AS cost, bool_or(pi IS NULL) AS unpriced FROM priced""")
def _(s, d):
    return providers.cost_summary(calls(s, d)).withColumn("cost", F.round("cost", 4))


@query("a20_delete_ticker", "SELECT id, ticker, period_idx FROM latest WHERE ticker <> 7")
def _(s, d):
    return latest(s, d).where(~F.col("ticker").eqNullSafe(F.lit(7))).select("id", "ticker", "period_idx")


@query("a08_file_text")
def _(s, d):
    """Bytes to text by the cascade, over the raw pages."""
    p = table(s, d, "pages").select("page_id", pdf.extract(F.col("html").cast("binary"), (("plain", pdf.plain_bytes),)).alias("r"))
    return p.select("page_id", "r.how", F.length("r.text").alias("n_chars"))


# --- B: projections and filters ---------------------------------------------------------

HISTORY = ["id", "ticker", "quarter", "fiscal_year", "score"]

for _i, _name in enumerate(("confidence", "narrative", "guidance", "risk")):
    @query(f"b0{_i + 1}_{_name}_history", f"SELECT id, ticker, quarter, fiscal_year, score FROM latest WHERE {kind_sql(_i)} AND ticker = 10 ORDER BY period_idx DESC, id LIMIT 8")
    def _(s, d, i=_i):
        return store.history(kind(latest(s, d), i), HISTORY, 10, 8)


@query("b05_documents_optional_quarter", "SELECT doc_id, quarter, fiscal_year FROM docs WHERE ticker = 'src1' AND quarter = 'Q2'")
def _(s, d):
    asked = {"ticker": "src1", "quarter": "Q2", "fiscal_year": None}
    out = docs(s, d)
    for c, v in asked.items():
        out = out if v is None else out.where(F.col(c) == v)
    return out.select("doc_id", "quarter", "fiscal_year")


@query("b06_point_lookup", "SELECT doc_id, md5(text) AS text_md5 FROM docs WHERE doc_id = 42")
def _(s, d):
    return docs(s, d).where("doc_id = 42").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("b07_period_triple", "SELECT id, score FROM sig WHERE ticker IN (28, 744) AND quarter = 'Q1' AND fiscal_year = 1999")
def _(s, d):
    return signals(s, d).where("ticker in (28, 744) and quarter = 'Q1' and fiscal_year = 1999").select("id", "score")


@query("b08_key_mismatch", """SELECT id FROM sig WHERE 'conf::' || coalesce(CASE WHEN id % 9 <> 0 THEN ticker::VARCHAR END, 'unknown') || '::' || quarter || '::' || fiscal_year <> 'conf::' || CASE WHEN id % 2 = 0 THEN ticker ELSE ticker + 1 END || '::' || quarter || '::' || fiscal_year""")
def _(s, d):
    t = signals(s, d)
    stored = F.concat_ws("::", F.lit("conf"), F.when(F.col("id") % 2 == 0, F.col("ticker")).otherwise(F.col("ticker") + 1).cast("string"), "quarter", F.col("fiscal_year").cast("string"))
    rows = t.select(F.col("id").alias("n"), stored.alias("id"), F.when(F.col("id") % 9 != 0, F.col("ticker").cast("string")).alias("ticker"), "quarter", "fiscal_year")
    return store.mismatched_keys(rows, "conf").select(F.col("n").alias("id"))


@query("b09_metadata_filter", "SELECT chunk_id, doc_id FROM lines WHERE ticker = 'src0' AND doc_type IN ('earnings_call', 'press_release') AND period_idx = 8100 AND contains(line, ',')")
def _(s, d):
    from ..operators.retrieval import metadata_filter

    rows = lines(s, d).withColumns({"quarter": periods.quarter_of(F.col("period_idx")), "fiscal_year": periods.year_of(F.col("period_idx")), "is_management": F.contains("line", F.lit(","))})
    return metadata_filter(rows, "src0", [("Q1", 2025)], ("earnings_call", "press_release"), None, True).select("chunk_id", "doc_id")


@query("b10_period_pairs", "SELECT doc_id FROM docs WHERE (quarter = 'Q1' AND fiscal_year = 2025) OR (quarter = 'Q3' AND fiscal_year = 2026)")
def _(s, d):
    from ..operators.retrieval import metadata_filter

    return metadata_filter(docs(s, d), periods=[("Q1", 2025), ("Q3", 2026), ("Q1", 2025)]).select("doc_id")


@query("b12_min_length", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) >= 200")
def _(s, d):
    return table(s, d, "documents").where(F.length(F.trim("text")) >= 200).select("doc_id", F.length(F.trim("text")).cast("long").alias("n"))


@query("b13_period_membership", "SELECT ordinal, coalesce(by_subject, by_date) AS period_idx FROM annp WHERE coalesce(by_subject, by_date) IN (8070, 8071, 8067)")
def _(s, d):
    a = announcements(s, d)
    a = a.select("ordinal", periods.document_period(F.col("subject"), F.col("event_date"), text.classify(F.col("subject")))["period_idx"].alias("period_idx"))
    wanted = s.createDataFrame([(8070,), (8071,), (8067,)], "period_idx int")
    return a.join(F.broadcast(wanted), "period_idx", "left_semi").select("ordinal", "period_idx")


@query("b14_type_exclusion", "SELECT ordinal, doc_type FROM annp WHERE doc_type IS NOT NULL AND doc_type <> 'annual_report'")
def _(s, d):
    allowed = [t for t in text.DEFAULT_DOC_TYPES if t != "annual_report"]
    return announcements(s, d).select("ordinal", text.classify(F.col("subject"), allowed).alias("doc_type")).where("doc_type is not null")


@query("b15_source_filter", "SELECT doc_type, count(*) AS n FROM docs WHERE quarter = 'Q2' AND fiscal_year = 2025 AND doc_type IN ('earnings_call', 'annual_report') GROUP BY 1")
def _(s, d):
    label, types = "Q2 FY25", ("earnings_call", "annual_report")
    out = docs(s, d).where(periods.format_period(F.col("quarter"), F.col("fiscal_year")) == label)
    return (out.where(F.col("doc_type").isin(*types)) if types else out).groupBy("doc_type").agg(F.count("*").alias("n"))


@query("b16_signal_present", "SELECT id, score > 5 OR id % 3 = 0 OR id % 5 = 0 AS present FROM sig")
def _(s, d):
    t = signals(s, d).select("id", F.when(F.col("score") > 5, F.col("score")).alias("score"), F.when(F.col("id") % 3 == 0, "text").otherwise("").alias("summary"),
                             F.when(F.col("id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("drivers"))
    return t.select("id", (F.col("score").isNotNull() | (F.coalesce("summary", F.lit("")) != "") | (F.size("drivers") > 0)).alias("present"))


@query("b17_sufficiency", "SELECT ticker, period_idx, count(*) AS n_chunks, count(*) >= 5 AS sufficient FROM lines GROUP BY ticker, period_idx")
def _(s, d):
    return lines(s, d).groupBy("ticker", "period_idx").agg(F.count("*").alias("n_chunks")).withColumn("sufficient", F.col("n_chunks") >= 5)


@query("b18_zero_is_unscored", "SELECT id, CASE WHEN tone > 0 THEN tone END AS shown FROM sig")
def _(s, d):
    return signals(s, d).select("id", F.when(F.col("tone") > 0, F.col("tone")).alias("shown"))


# --- D: aggregations --------------------------------------------------------------------

@query("d01_count_by_ticker", "SELECT ticker, count(*) AS n FROM sig GROUP BY ticker")
def _(s, d):
    return signals(s, d).groupBy("ticker").agg(F.count("*").alias("n")).orderBy("ticker")


@query("d02_filtered_count", "SELECT count(*) FILTER (WHERE score >= 5) AS n FROM sig")
def _(s, d):
    return signals(s, d).where("score >= 5").agg(F.count("*").alias("n"))


@query("d03_ytd_hit_rate", """SELECT ticker, fiscal_year, sum(beats)::BIGINT AS beats, sum(in_line)::BIGINT AS in_line, sum(misses)::BIGINT AS misses, sum(beats + in_line + misses)::BIGINT AS tracked,
round((sum(beats) + sum(in_line))::DOUBLE / nullif(sum(beats + in_line + misses), 0), 4) AS hit_rate, round(sum(beats)::DOUBLE / nullif(sum(beats + in_line + misses), 0), 4) AS beat_rate,
string_agg(DISTINCT quarter, ',' ORDER BY quarter) AS quarters FROM guid GROUP BY ticker, fiscal_year""")
def _(s, d):
    y = aggregates.ytd_guidance(guidance(s, d))
    return y.withColumns({"hit_rate": F.round("hit_rate", 4), "beat_rate": F.round("beat_rate", 4), "quarters": F.array_join("quarters", ",")})


@query("d04_serial_miss_ytd", "SELECT ticker, fiscal_year, lower(trim(metric)) AS metric, count(*) AS n FROM items WHERE outcome = 'miss' GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def _(s, d):
    return aggregates.serial_misses(items(s, d), ["ticker", "fiscal_year"])


@query("d05_serial_miss_signal", "SELECT ticker, period_idx, lower(trim(metric)) AS metric, count(*) AS n FROM items WHERE outcome = 'miss' AND trim(metric) <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def _(s, d):
    return aggregates.serial_misses(items(s, d), ["ticker", "period_idx"])


@query("d06_ordered_distinct_union", """WITH ev AS (SELECT ticker, fiscal_year, quarter AS q, l_orderkey * 10 + l_linenumber AS pos, CASE outcome WHEN 'beat' THEN 'new' WHEN 'in_line' THEN 'escalating' ELSE 'diminishing' END AS list, lower(metric) AS risk FROM items),
f AS (SELECT ticker, fiscal_year, list, risk, min({q: q, pos: pos}) AS first FROM ev GROUP BY 1, 2, 3, 4),
g AS (SELECT ticker, fiscal_year, string_agg(risk, ',' ORDER BY first, risk) FILTER (WHERE list = 'new') AS nw, string_agg(risk, ',' ORDER BY first, risk) FILTER (WHERE list = 'escalating') AS es, string_agg(risk, ',' ORDER BY first, risk) FILTER (WHERE list = 'diminishing') AS di,
 string_agg(risk, ',' ORDER BY first, risk) FILTER (WHERE list = 'new' AND NOT EXISTS (SELECT 1 FROM f x WHERE x.ticker = f.ticker AND x.fiscal_year = f.fiscal_year AND x.risk = f.risk AND x.list = 'diminishing')) AS ac FROM f GROUP BY 1, 2)
SELECT ticker, fiscal_year, coalesce(nw, '') AS new_risks, coalesce(es, '') AS escalating, coalesce(di, '') AS diminishing, coalesce(ac, '') AS active FROM g""")
def _(s, d):
    ev = items(s, d).select(
        "ticker", "fiscal_year", F.col("quarter").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("outcome") == "beat", "new").when(F.col("outcome") == "in_line", "escalating").otherwise("diminishing").alias("list"), F.lower("metric").alias("risk"), F.lit("medium").alias("severity"))
    y = aggregates.ytd_risks(ev)
    return y.select("ticker", "fiscal_year", F.array_join("new", ",").alias("new_risks"), *[F.array_join(c, ",").alias(c) for c in ("escalating", "diminishing", "active")])


RANK = "CASE o_orderkey % 4 WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


@query("d07_severity_max", "SELECT ticker, fiscal_year, CASE max(id % 4) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM sig GROUP BY 1, 2")
def _(s, d):
    from ..operators.scoring import severity_rank

    label = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (F.col("id") % 4 + 1).cast("int"))
    t = signals(s, d).withColumn("severity", label)
    return t.groupBy("ticker", "fiscal_year").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))


@query("d08_outcome_counts", "SELECT ticker, period_idx, count_if(outcome = 'beat')::BIGINT AS beats, count_if(outcome = 'in_line')::BIGINT AS in_line, count_if(outcome = 'miss')::BIGINT AS misses, 0::BIGINT AS withdrawals FROM items GROUP BY 1, 2")
def _(s, d):
    return aggregates.outcome_counts(items(s, d), ["ticker", "period_idx"])


@query("d09_count_by_type", "SELECT doc_type, count(*) AS n FROM docs GROUP BY doc_type")
def _(s, d):
    return docs(s, d).groupBy("doc_type").agg(F.count("*").alias("n"))


@query("d10_docs_per_period", "SELECT ticker, period_idx, count(*) AS n FROM docs GROUP BY 1, 2")
def _(s, d):
    return docs(s, d).groupBy("ticker", "period_idx").agg(F.count("*").alias("n"))


@query("d11_periods_per_url", "SELECT source_url, count(DISTINCT period_idx) AS n_periods FROM docs GROUP BY 1 HAVING count(DISTINCT period_idx) > 1")
def _(s, d):
    return docs(s, d).groupBy("source_url").agg(F.count_distinct("period_idx").alias("n_periods")).where("n_periods > 1")


@query("d14_mean_tone", "SELECT ticker, coalesce(avg(CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END), 0.0)::DOUBLE AS tone FROM sig GROUP BY ticker")
def _(s, d):
    label = F.when(F.col("id") % 4 == 0, "Confident").when(F.col("id") % 4 == 1, "cautious").when(F.col("id") % 4 == 2, "neutral").otherwise("other")
    return signals(s, d).groupBy("ticker").agg(F.coalesce(F.avg(providers.tone_value(label)), F.lit(0.0)).alias("tone"))


@query("d15_verified_sentiment", "SELECT event_type AS theme, round(avg((event_id % 41 - 20)::DOUBLE / 20), 6) AS sentiment, count(*) AS n FROM events WHERE value > 1 GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").where("value > 1")
    return e.groupBy(F.col("event_type").alias("theme")).agg(F.round(F.avg((F.col("event_id") % 41 - 20) / 20), 6).alias("sentiment"), F.count("*").alias("n"))


@query("d16_word_count", "SELECT ticker, greatest(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'))), 1)::BIGINT AS words FROM docs GROUP BY ticker")
def _(s, d):
    return docs(s, d).groupBy("ticker").agg(F.greatest(F.sum(text.word_count(F.col("text"))), F.lit(1)).cast("long").alias("words"))


@query("d17_density", "SELECT doc_id, (length(text) - length(replace(text, ',', '')))::DOUBLE / greatest(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 1) * 1000 AS per_1000 FROM docs")
def _(s, d):
    from ..functions.numbers import per_thousand

    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    return docs(s, d).select("doc_id", per_thousand(commas, text.word_count(F.col("text"))).alias("per_1000"))


@query("d18_any_all", "SELECT ticker, bool_or(wide) AS any_wide, bool_and(wide) AS all_wide FROM sig GROUP BY ticker")
def _(s, d):
    return signals(s, d).groupBy("ticker").agg(F.bool_or("wide").alias("any_wide"), F.bool_and("wide").alias("all_wide"))


@query("d20_cost_by_model", f"""WITH calls AS ({CALLS}) SELECT model, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, bool_or(model = 'other') AS unpriced FROM calls GROUP BY model""")
def _(s, d):
    return calls(s, d).groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").cast("long").alias("tokens_out"), F.bool_or(F.col("price_in").isNull()).alias("unpriced"))


@query("d21_totals", "SELECT count(DISTINCT doc_id) AS docs, count(*) AS chunks FROM lines")
def _(s, d):
    return lines(s, d).agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("chunks"))


@query("d22_window_span", "SELECT min(generated_at) AS first, max(generated_at) AS last FROM sig WHERE period_idx BETWEEN 7988 AND 7992")
def _(s, d):
    return signals(s, d).where("period_idx between 7988 and 7992").agg(F.min("generated_at").alias("first"), F.max("generated_at").alias("last"))


@query("d23_verdict", """WITH st AS (SELECT o_custkey AS c, CASE o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' WHEN 2 THEN 'SKIP' ELSE 'PASS' END AS status FROM orders),
n AS (SELECT count_if(status = 'PASS')::BIGINT AS pass, count_if(status = 'FAIL')::BIGINT AS fail, count_if(status = 'WARN')::BIGINT AS warn, count_if(status = 'SKIP')::BIGINT AS skip FROM st)
SELECT *, CASE WHEN fail > 0 THEN 'NOT TRUSTWORTHY' WHEN pass + warn < 3 THEN 'INCONCLUSIVE' WHEN warn > 0 THEN 'WARN' ELSE 'DEFENSIBLE' END AS verdict FROM n""")
def _(s, d):
    k = F.col("o_orderkey")
    return aggregates.verdict(table(s, d, "orders").select(F.when(k % 7 == 0, "FAIL").when(k % 7 == 1, "WARN").when(k % 7 == 2, "SKIP").otherwise("PASS").alias("status")))


FINGERPRINT = """WITH n AS (SELECT ticker, period_idx, doc_id, count(*) AS n_chunks FROM lines GROUP BY 1, 2, 3)
SELECT ticker, period_idx, substr(sha256(string_agg(doc_id || ':' || n_chunks, '|' ORDER BY doc_id || ':' || n_chunks) || '||m1||v1||p1'), 1, 32) AS fingerprint FROM n GROUP BY 1, 2"""


@query("d24_fingerprint", FINGERPRINT)
def _(s, d):
    n = lines(s, d).groupBy("ticker", "period_idx", "doc_id").agg(F.count("*").alias("n_chunks"))
    return store.corpus_fingerprint(n, ["ticker", "period_idx"], "m1", "v1", "p1")


@query("d25_evidence_text", "SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS evidence FROM lines GROUP BY 1")
def _(s, d):
    packed = F.array_sort(F.collect_list(F.struct("pos", "line")))
    g = lines(s, d).groupBy("doc_id").agg(packed.alias("p"))
    return g.select("doc_id", F.md5(F.concat_ws("\n", F.transform("p", lambda x: x["line"])).cast("binary")).alias("evidence"))


@query("d26_distinct_tickers", "SELECT DISTINCT ticker FROM sig")
def _(s, d):
    return signals(s, d).select("ticker").distinct().orderBy("ticker")


@query("d29_hit_rate", "SELECT ticker, period_idx, round((beats + in_line)::DOUBLE / nullif(beats + in_line + misses, 0), 6) AS hit_rate FROM guid")
def _(s, d):
    return aggregates.hit_rates(guidance(s, d)).select("ticker", "period_idx", F.round("hit_rate", 6).alias("hit_rate"))


@query("d30_available_periods", "SELECT DISTINCT ticker, period_idx FROM sig")
def _(s, d):
    return signals(s, d).select("ticker", "period_idx").distinct().orderBy("ticker", F.desc("period_idx"))


# --- E: windows -------------------------------------------------------------------------

@query("e01_latest_wins", "SELECT id, ticker, quarter, fiscal_year, score FROM latest")
def _(s, d):
    return latest(s, d).select("id", "ticker", "quarter", "fiscal_year", "score")


@query("e02_newest_row", "SELECT ticker, period_idx, max(struct_pack(g := generated_at, i := id)).i AS id FROM sig GROUP BY 1, 2")
def _(s, d):
    return signals(s, d).groupBy("ticker", "period_idx").agg(F.max(F.struct("generated_at", "id"))["id"].alias("id"))


RANKED = """SELECT *, row_number() OVER (PARTITION BY period_idx ORDER BY CASE doc_type WHEN 'earnings_call' THEN 0 WHEN 'investor_presentation' THEN 1 WHEN 'press_release' THEN 2 WHEN 'annual_report' THEN 3 ELSE 4 END, event_date ASC NULLS FIRST, ordinal) AS rnk
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS n FROM (SELECT *, coalesce(by_subject, by_date) AS period_idx FROM annp WHERE doc_type IS NOT NULL) WHERE period_idx IN (8065, 8066, 8070)) WHERE n = 1"""


@query("e03_rank_and_cap", f"SELECT ordinal, period_idx, doc_type, rnk AS rank FROM ({RANKED}) WHERE rnk <= 15")
def _(s, d):
    wanted = s.createDataFrame([(8065,), (8066,), (8070,)], "period_idx int")
    a = announcements(s, d).withColumn("urls", F.array("url")).drop("url")
    return ann_source.candidates(a, wanted).select("ordinal", "period_idx", "doc_type", F.col("rank").cast("long").alias("rank"))


@query("e04_url_first_seen", "SELECT url, min(ordinal) AS ordinal FROM ann GROUP BY url")
def _(s, d):
    w = Window.partitionBy("url").orderBy("ordinal")
    return announcements(s, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("url", "ordinal")


@query("e05_content_dedupe", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY period_idx, doc_id) AS n FROM docs) WHERE n = 1")
def _(s, d):
    return store.latest_by(docs(s, d).withColumn("h", F.sha2(F.col("text").cast("binary"), 256)), ["h"], F.col("period_idx"), F.col("doc_id")).select("doc_id")


@query("e06_miss_streak", "SELECT ticker, period_idx, streak FROM guid")
def _(s, d):
    return guidance(s, d).select("ticker", "period_idx", "streak")


@query("e07_recent_pattern", """SELECT ticker, period_idx, string_agg(outcome, ',' ORDER BY n DESC) AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_idx ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM items) WHERE n <= 6 GROUP BY 1, 2""")
def _(s, d):
    packed = F.array_sort(F.collect_list(F.struct(*LINE, "outcome")))
    g = items(s, d).groupBy("ticker", "period_idx").agg(packed.alias("p"))
    return g.select("ticker", "period_idx", F.array_join(F.transform(F.slice("p", -F.least(F.lit(6), F.size("p")), F.lit(6)), lambda x: x["outcome"]), ",").alias("pattern"))


@query("e08_running_offset", "SELECT chunk_id, doc_id, pos, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM lines")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines(s, d).select("chunk_id", "doc_id", "pos", F.coalesce(F.sum(F.length("line")).over(w), F.lit(0)).alias("char_start"))


@query("e10_trend_series", "SELECT ticker, period_idx, score, row_number() OVER (PARTITION BY ticker ORDER BY period_idx) AS place FROM latest")
def _(s, d):
    w = Window.partitionBy("ticker").orderBy("period_idx")
    return latest(s, d).select("ticker", "period_idx", "score", F.row_number().over(w).cast("long").alias("place"))


# --- F, G: order, limits, sets ----------------------------------------------------------

@query("f01_newest_periods", "SELECT id, ticker, period_idx FROM latest ORDER BY period_idx DESC, id LIMIT 8")
def _(s, d):
    return latest(s, d).orderBy(F.desc("period_idx"), "id").limit(8).select("id", "ticker", "period_idx")


@query("f02_document_list", "SELECT doc_id, quarter, fiscal_year FROM docs WHERE ticker = 'src1' ORDER BY fiscal_year DESC, quarter DESC, doc_id LIMIT 20")
def _(s, d):
    return docs(s, d).where("ticker = 'src1'").orderBy(F.desc("fiscal_year"), F.desc("quarter"), "doc_id").limit(20).select("doc_id", "quarter", "fiscal_year")


@query("f03_top_risks", "SELECT ticker, id, rank FROM (SELECT ticker, id, row_number() OVER (PARTITION BY ticker ORDER BY id % 4 DESC, id) AS rank FROM sig) WHERE rank <= 5")
def _(s, d):
    w = Window.partitionBy("ticker").orderBy(F.desc(F.col("id") % 4), "id")
    return signals(s, d).select("ticker", "id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 5")


@query("f13_upsert_total", "SELECT count(DISTINCT chunk_id) AS total FROM lines")
def _(s, d):
    stored = lines(s, d).where("doc_type = 'earnings_call'").dropDuplicates(["chunk_id"])
    fresh = store.new_rows(lines(s, d), stored, "chunk_id")
    return stored.unionByName(fresh).agg(F.count("*").alias("total"))


@query("f14_collection_count", "SELECT count(*) AS n FROM lines WHERE ticker = 'src2'")
def _(s, d):
    return lines(s, d).where("ticker = 'src2'").agg(F.count("*").alias("n"))


@query("f15_truncations", "SELECT ticker, period_idx, string_agg(chunk_id, ',' ORDER BY doc_id, pos) AS cited FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_idx ORDER BY doc_id, pos) AS n FROM lines) WHERE n <= 8 GROUP BY 1, 2")
def _(s, d):
    w = Window.partitionBy("ticker", "period_idx").orderBy("doc_id", "pos")
    top = lines(s, d).withColumn("n", F.row_number().over(w)).where("n <= 8")
    g = top.groupBy("ticker", "period_idx").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("p"))
    return g.select("ticker", "period_idx", F.array_join(F.transform("p", lambda x: x["chunk_id"]), ",").alias("cited"))


@query("g01_period_union", "SELECT period_idx FROM latest WHERE status <> 'P' UNION SELECT period_idx FROM latest WHERE status <> 'O'")
def _(s, d):
    t = latest(s, d)
    return kind(t, 1).select("period_idx").union(kind(t, 2).select("period_idx")).distinct()


@query("g02_intersection", "SELECT chunk_id FROM lines WHERE period_idx = 8100 INTERSECT SELECT chunk_id FROM lines WHERE period_idx <> 8101")
def _(s, d):
    t = lines(s, d)
    return t.where("period_idx = 8100").select("chunk_id").intersect(t.where("period_idx <> 8101").select("chunk_id"))


@query("g03_difference", "SELECT ticker FROM latest WHERE status <> 'P' EXCEPT SELECT ticker FROM latest WHERE status = 'O'")
def _(s, d):
    t = latest(s, d)
    return kind(t, 1).select("ticker").subtract(t.where("status = 'O'").select("ticker"))


@query("g04_ordered_distinct", "SELECT ticker, string_agg(quarter, ',' ORDER BY first) AS quarters FROM (SELECT ticker, quarter, min({g: generated_at, i: id}) AS first FROM sig GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    seen = aggregates.ordered_distinct(signals(s, d), ["ticker"], "quarter", [F.col("generated_at"), F.col("id")])
    g = seen.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("first", "quarter"))).alias("p"))
    return g.select("ticker", F.array_join(F.transform("p", lambda x: x["quarter"]), ",").alias("quarters"))


# --- J: mutations -----------------------------------------------------------------------

for _i, _name in enumerate(PAYLOAD):
    _columns = ", ".join(["id", "ticker", "quarter", "fiscal_year", *PAYLOAD[_name]])

    @query(f"j0{_i + 1}_upsert_{_name}", f"SELECT {_columns} FROM {stored_sql(_name)}".replace("round(score * 10) AS score", "round(score * 10) AS score"))
    def _(s, d, name=_name):
        """Two upserts of a signal table, then the rows that win."""
        rows = store_of(s, d, name).rows(f"{name}_signals")
        return rows.select("id", "ticker", "quarter", "fiscal_year", *PAYLOAD[name])


@query("j05_upsert_manifest", """SELECT 'confidence::' || id AS id, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN 'v2' ELSE 'v1' END AS manifest FROM sig""")
def _(s, d):
    """A later manifest replaces the first; a null one is not stored."""
    made = store.SignalStore(s, store.shared_folder(s, "manifests"))
    t = signals(s, d)
    row = [F.concat(F.lit("confidence::"), F.col("id").cast("string")).alias("id"), F.lit("confidence").alias("signal_type"), F.col("ticker").cast("string").alias("ticker"), "quarter", "fiscal_year"]
    made.upsert("signal_manifests", t.select(*row, F.lit("v1").alias("manifest"), "generated_at"))
    made.upsert("signal_manifests", t.where("id % 4 = 0").select(*row, F.when(F.col("id") % 8 != 0, "v2").alias("manifest"), (F.col("generated_at") + F.expr("INTERVAL 1 DAY")).alias("generated_at")))
    return made.rows("signal_manifests").select("id", "manifest")


@query("j06_upsert_document", "SELECT doc_id::VARCHAR AS doc_id, upper(ticker) AS ticker, md5(substr(text, 1, 60000)) AS text_md5, least(length(text), 60000)::INT AS n FROM docs")
def _(s, d):
    """Documents are stored with their text capped as for chunking."""
    rows = store_of(s, d, documents=True).rows("ingested_documents")
    return rows.select("doc_id", "ticker", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"), F.length("raw_text").alias("n"))


@query("j07_upsert_run", "SELECT 'run::' || id AS id, CASE WHEN wide THEN 'f2' ELSE 'f1' END AS fingerprint FROM sig")
def _(s, d):
    made = store.SignalStore(s, store.shared_folder(s, "runs"))
    t = signals(s, d)
    row = [F.concat(F.lit("run::"), F.col("id").cast("string")).alias("id"), F.col("ticker").cast("string").alias("ticker"), "quarter", "fiscal_year"]
    made.upsert("signal_runs", t.select(*row, F.lit("f1").alias("fingerprint"), F.col("generated_at").alias("scored_at")))
    made.upsert("signal_runs", t.where("wide").select(*row, F.lit("f2").alias("fingerprint"), (F.col("generated_at") + F.expr("INTERVAL 1 DAY")).alias("scored_at")))
    return made.rows("signal_runs").select("id", "fingerprint")


@query("j08_legacy_repair", "SELECT 'conf::' || ticker || '::' || quarter || '::' || fiscal_year AS id, ticker, quarter, fiscal_year, score FROM latest")
def _(s, d):
    t = signals(s, d).withColumns({"ticker": F.col("ticker").cast("string")})
    return store.rekey(store.rekey(t, "conf"), "conf").select("id", F.col("ticker").cast("long").alias("ticker"), "quarter", "fiscal_year", "score")


@query("j09_vector_delete", "SELECT chunk_id, doc_id FROM lines WHERE ticker <> 'src4'")
def _(s, d):
    return lines(s, d).where(~F.col("ticker").eqNullSafe(F.lit("src4"))).select("chunk_id", "doc_id")


@query("n09_tickers", "SELECT DISTINCT ticker FROM docs")
def _(s, d):
    return docs(s, d).select("ticker").distinct().orderBy(sort_key("ticker"))


@query("n14_sources_tab", """SELECT doc_id, quarter, fiscal_year, doc_type, source_url, count(*) OVER (PARTITION BY quarter, fiscal_year, doc_type) AS n_of_type FROM docs
WHERE quarter = 'Q2' AND fiscal_year = 2025 AND doc_type IN ('earnings_call', 'annual_report')""")
def _(s, d):
    """The documents of a period and of some types, newest first, each with the count of its type."""
    asked = docs(s, d).where((periods.format_period(F.col("quarter"), F.col("fiscal_year")) == "Q2 FY25") & F.col("doc_type").isin("earnings_call", "annual_report"))
    of_type = asked.groupBy("quarter", "fiscal_year", "doc_type").agg(F.count("*").alias("n_of_type"))
    return asked.join(of_type, ["quarter", "fiscal_year", "doc_type"]).select("doc_id", "quarter", "fiscal_year", "doc_type", "source_url", "n_of_type").orderBy("doc_type", "doc_id")


@query("n15_db_coverage", "SELECT ticker, period_idx, TRUE AS has_confidence, bool_or(status <> 'P') AS has_narrative, bool_or(status <> 'O') AS has_guidance, bool_or(status <> 'F') AS has_risk FROM latest GROUP BY 1, 2")
def _(s, d):
    t = latest(s, d)
    return compare.coverage({n: kind(t, i) for i, n in enumerate(("confidence", "narrative", "guidance", "risk"))})
