"""Scalar functions over dates, strings, numbers and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonfn, numbers, periods, text
from ..sources.announcements import lenient_time
from .domain import announcements, docs, lines, query, signals, table, theme_pairs


@query("h01_format_period", "SELECT id, quarter || ' FY' || lpad((fiscal_year % 100)::VARCHAR, 2, '0') AS label FROM sig")
def _(s, d):
    return signals(s, d).select("id", periods.format_period(F.col("quarter"), F.col("fiscal_year")).alias("label"))


@query("h02_parse_period", "SELECT id, quarter, fiscal_year FROM sig")
def _(s, d):
    t = signals(s, d)
    label = F.when(F.col("id") % 2 == 0, F.format_string("%s FY%02d", F.col("quarter"), F.col("fiscal_year") % 100)).otherwise(F.concat_ws(" ", "quarter", F.col("fiscal_year").cast("string")))
    # two-digit years are read as 20xx, so labels of the 1990s are written in full
    label = F.when(F.col("fiscal_year") < 2000, F.concat_ws(" ", "quarter", F.col("fiscal_year").cast("string"))).otherwise(label)
    return t.select("id", periods.parse_period(label).alias("p")).select("id", "p.quarter", "p.fiscal_year")


@query("h03_fiscal_quarter", "SELECT id, quarter, fiscal_year, period_idx FROM sig")
def _(s, d):
    return signals(s, d).select("id", "quarter", "fiscal_year", "period_idx")


@query("h04_quarter_bounds", """SELECT DISTINCT period_idx, make_date(CASE WHEN period_idx % 4 = 3 THEN period_idx // 4 ELSE period_idx // 4 - 1 END, CASE period_idx % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 ELSE 1 END, 1)::TIMESTAMP AS first,
make_date(CASE WHEN period_idx % 4 = 3 THEN period_idx // 4 ELSE period_idx // 4 - 1 END, CASE period_idx % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 ELSE 1 END, 1)::TIMESTAMP + INTERVAL 3 MONTH - INTERVAL 1 SECOND AS last FROM sig""")
def _(s, d):
    return signals(s, d).select("period_idx").distinct().select("period_idx", periods.quarter_start(F.col("period_idx")).alias("first"), periods.quarter_end(F.col("period_idx")).alias("last"))


@query("h05_search_window", """WITH b AS (SELECT DISTINCT period_idx, make_date(CASE WHEN period_idx % 4 = 3 THEN period_idx // 4 ELSE period_idx // 4 - 1 END, CASE period_idx % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 ELSE 1 END, 1)::TIMESTAMP AS first FROM sig)
SELECT period_idx, first AS start, greatest(first, least(first + INTERVAL 3 MONTH - INTERVAL 1 SECOND + INTERVAL 90 DAY, TIMESTAMP '1999-02-15')) AS results_end, greatest(first, least(first + INTERVAL 3 MONTH - INTERVAL 1 SECOND + INTERVAL 200 DAY, TIMESTAMP '1999-02-15')) AS annual_end FROM b""")
def _(s, d):
    now = F.lit("1999-02-15 00:00:00").cast("timestamp_ntz")
    t = signals(s, d).select("period_idx").distinct()
    a, b = periods.search_window(F.col("period_idx"), now), periods.search_window(F.col("period_idx"), now, annual=True)
    return t.select("period_idx", a["start"].alias("start"), a["end"].alias("results_end"), b["end"].alias("annual_end"))


@query("h06_prior_and_yoy", "SELECT DISTINCT period_idx, 'Q' || ((period_idx - 1) % 4 + 1) AS prior_quarter, ((period_idx - 1) // 4)::INT AS prior_year, quarter AS yoy_quarter, (fiscal_year - 1)::INT AS yoy_year FROM sig")
def _(s, d):
    i = F.col("period_idx")
    return signals(s, d).select(i, periods.quarter_of(i - 1).alias("prior_quarter"), periods.year_of(i - 1).alias("prior_year"), periods.quarter_of(i - 4).alias("yoy_quarter"), periods.year_of(i - 4).alias("yoy_year")).distinct()


@query("h07_latest_completed", "SELECT id, (period_idx - 1)::INT AS latest FROM sig")
def _(s, d):
    return signals(s, d).select("id", periods.last_ended(F.col("generated_at")).alias("latest"))


@query("h08_period_from_subject", "SELECT ordinal, named AS period_idx FROM annp")
def _(s, d):
    return announcements(s, d).select("ordinal", periods.period_from_subject(F.col("subject")).alias("period_idx"))


PERIOD = "SELECT ordinal, coalesce(by_subject, by_date) AS period_idx, CASE WHEN by_subject IS NOT NULL THEN 'subject' WHEN by_date IS NOT NULL THEN 'event_date' ELSE 'unknown' END AS source FROM annp"


@query("h09_document_period", "SELECT ordinal, coalesce(named, by_date) AS period_idx, CASE WHEN named IS NOT NULL THEN 'subject' WHEN by_date IS NOT NULL THEN 'event_date' ELSE 'unknown' END AS source FROM annp")
def _(s, d):
    return announcements(s, d).select("ordinal", periods.document_period(F.col("subject"), F.col("event_date")).alias("p")).select("ordinal", "p.period_idx", "p.source")


@query("h10_annual_report_override", PERIOD)
def _(s, d):
    p = periods.document_period(F.col("subject"), F.col("event_date"), text.classify(F.col("subject")))
    return announcements(s, d).select("ordinal", p.alias("p")).select("ordinal", "p.period_idx", "p.source")


@query("h11_lenient_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate END AS parsed FROM orders")
def _(s, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(t, "dd-MMM-yyyy HH:mm:ss")).when(k % 4 == 2, F.date_format(t, "dd/MM/yyyy HH:mm:ss")).otherwise("soon")
    return table(s, d, "orders").select("o_orderkey", lenient_time(raw).alias("parsed"))


@query("h20_classify", "SELECT ordinal, doc_type FROM annp")
def _(s, d):
    return announcements(s, d).select("ordinal", text.classify(F.col("subject")).alias("doc_type"))


@query("h21_doc_id", "SELECT ordinal, substr(md5(ticker || '::' || source || '::' || url), 1, 16) AS doc_id FROM ann")
def _(s, d):
    return announcements(s, d).select("ordinal", text.md5_id(F.col("ticker"), F.col("source"), F.col("url")).alias("doc_id"))


@query("h22_chunk_id", "SELECT doc_id, pos, chunk_id FROM lines")
def _(s, d):
    return lines(s, d).select("doc_id", "pos", text.md5_id(F.col("doc_id"), F.col("pos"), F.substring("line", 1, 40)).alias("chunk_id"))


@query("h23_cache_key", "SELECT page_id, substr(sha256(url), 1, 32) AS cache_key, substr(sha256(html), 1, 16) AS content_hash FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", text.sha_key(F.col("url"), 32).alias("cache_key"), text.sha_key(F.col("html"), 16).alias("content_hash"))


@query("h24_corpus_fingerprint", """WITH n AS (SELECT ticker, quarter, fiscal_year, doc_id, 1 AS n FROM docs) SELECT ticker, quarter, fiscal_year, substr(sha256(string_agg(doc_id || ':' || n, '|' ORDER BY doc_id || ':' || n) || '||m||v||p'), 1, 32) AS fingerprint FROM n GROUP BY 1, 2, 3""")
def _(s, d):
    from ..operators.store import corpus_fingerprint

    return corpus_fingerprint(docs(s, d).withColumn("n_chunks", F.lit(1)), model="m", version="v", profile="p")


@query("h25_narration_fingerprint")
def _(s, d):
    return signals(s, d).select("id", F.substring(F.sha2(F.to_json(F.struct("hedges", "tone")).cast("binary"), 256), 1, 16).alias("fingerprint"))


@query("h26_natural_key", "SELECT id, 'conf::' || coalesce(CASE WHEN id % 4 <> 0 THEN ticker::VARCHAR END, 'unknown') || '::' || quarter || '::' || coalesce(CASE WHEN id % 5 <> 0 THEN fiscal_year::VARCHAR END, 'unknown') AS key FROM sig")
def _(s, d):
    i = F.col("id")
    return signals(s, d).select("id", text.natural_key("conf", F.when(i % 4 != 0, F.col("ticker").cast("string")), F.col("quarter"), F.when(i % 5 != 0, F.col("fiscal_year"))).alias("key"))


@query("h27_normalize_quote", """SELECT doc_id, pos, md5(lower(regexp_replace(trim(regexp_replace(translate(line, '‘’“”–—', '''''""--'), '\\s+', ' ', 'g')), '^["'']+|["'']+$', '', 'g'))) AS h FROM lines""")
def _(s, d):
    return lines(s, d).select("doc_id", "pos", F.md5(text.normalize_quote(F.col("line"), compatibility=False).cast("binary")).alias("h"))


@query("h27_normalize_quote_nfkd")
def _(s, d):
    return lines(s, d).select("doc_id", "pos", F.md5(text.normalize_quote(F.col("line")).cast("binary")).alias("h"))


@query("h28_squash", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))) AS h FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.squash(F.col("text")).cast("binary")).alias("h"))


@query("h29_sequence_ratio")
def _(s, d):
    from ..operators.compare import similarity

    p = table(s, d, "part")
    return p.select("p_partkey", F.round(similarity(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


WORDS = ("Opening remarks by the chair", "Questions from analysts", "Revenue and net income rose", "Our outlook is stable", "A material risk remains", "The roadmap is long-term", "The industry slowed", "Thanks to all")


@query("h30_detect_section", "SELECT id, CASE id % 8 WHEN 0 THEN 'prepared_remarks' WHEN 1 THEN 'qa_session' WHEN 2 THEN 'financial_results' WHEN 3 THEN 'guidance' WHEN 4 THEN 'risk_factors' WHEN 5 THEN 'strategy' WHEN 6 THEN 'market_overview' ELSE 'unknown' END AS section FROM sig")
def _(s, d):
    words = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % 8 + 1).cast("int"))
    return signals(s, d).select("id", text.section(words).alias("section"))


@query("h31_speaker_lines", "SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) AS speaker, role = 'assistant' AS is_management FROM conversations")
def _(s, d):
    c = table(s, d, "conversations")
    line = F.concat(F.initcap("role"), F.when(F.col("role") == "assistant", F.lit(" : as President")).otherwise(F.lit(" : none")))
    return c.select("conv_id", "turn", F.trim(F.regexp_extract(line, r"^([A-Z][a-zA-Z \t\-]{2,40})[ \t]*[:\-–]", 1)).alias("speaker"), line.rlike(r"(?i)\b(ceo|president|cfo)\b").alias("is_management"))


@query("h32_markdown_lines", "SELECT doc_id, pos, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AND length(trim(line)) > 1 AS is_table, ends_with(trim(line), '|') AS ends FROM lines")
def _(s, d):
    return lines(s, d).select("doc_id", "pos", F.col("line").rlike(r"^\s*\|.*\|\s*$").alias("is_table"), F.col("line").rlike(r"\|\s*$").alias("ends"))


@query("h33_sentence_split", "SELECT doc_id, pos, len(regexp_extract_all(trim(line), '[.!?][ \\t]+')) + 1 AS n FROM lines")
def _(s, d):
    return lines(s, d).select("doc_id", "pos", F.size(text.sentences(F.col("line"))).cast("long").alias("n"))


@query("h34_title", "SELECT ordinal, substr(subject || ' — ' || url, 1, 60) AS title FROM ann")
def _(s, d):
    return announcements(s, d).select("ordinal", F.substring(F.concat_ws(" — ", "subject", "url"), 1, 60).alias("title"))


@query("h35_slug", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("h35_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("h"))


@query("h37_token_count", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n"))


@query("h40_clamp", "SELECT id, greatest(0::DOUBLE, least(1::DOUBLE, tone * 2)) AS x FROM sig")
def _(s, d):
    return signals(s, d).select("id", (numbers.clamp(F.col("tone") * 2, 0.0, 1.0) + 0.0).alias("x"))


@query("h41_py_round", "SELECT id, round_even(hedges / 2, 0)::DOUBLE AS whole FROM sig")
def _(s, d):
    return signals(s, d).select("id", numbers.py_round(F.col("hedges") / 2).alias("whole"))


@query("h41_py_round_tenths")
def _(s, d):
    return signals(s, d).select("id", numbers.py_round(F.col("score") / 3, 1).alias("x"))


@query("h42_sigmoid", "SELECT id, round(1 / (1 + exp(-tone * 3)), 9) AS x FROM sig")
def _(s, d):
    return signals(s, d).select("id", F.round(numbers.sigmoid(F.col("tone") * 3), 9).alias("x"))


@query("h43_mention_ratio", "SELECT ticker, period_idx, theme, CASE WHEN prev > 0 THEN round(cur::DOUBLE / prev, 9) WHEN cur > 0 THEN 'Infinity'::DOUBLE ELSE 1 END AS r FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select("ticker", "period_idx", "theme", F.round(numbers.ratio(F.col("cur"), F.col("prev")), 9).alias("r")).withColumn("r", F.when(F.col("r") > 1e300, F.lit(float("inf"))).otherwise(F.col("r")))


@query("h44_theme_ratio", "SELECT id, CASE WHEN defensive > 0 THEN round(superlatives::DOUBLE / defensive, 9) ELSE -1 END AS r FROM sig")
def _(s, d):
    r = numbers.ratio(F.col("superlatives"), F.col("defensive"), even_if_both_zero=True)
    return signals(s, d).select("id", F.when(r == float("inf"), -1.0).otherwise(F.round(r, 9)).alias("r"))


@query("h45_hedge_penalty", "SELECT id, round(-1.5::DOUBLE * least(1::DOUBLE, greatest(0::DOUBLE, hedges - 5) / 10), 9) + 0 AS x FROM sig")
def _(s, d):
    from ..operators.scoring import hedge_penalty

    return signals(s, d).select("id", (F.round(hedge_penalty(F.col("hedges")), 9) + 0.0).alias("x"))


@query("h46_safe_casts", "SELECT id, CASE WHEN id % 3 = 0 THEN hedges WHEN id % 3 = 1 THEN 3.7 ELSE -1 END::DOUBLE AS d, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 9 ELSE 9 END::INT AS i FROM sig")
def _(s, d):
    i = F.col("id")
    return signals(s, d).select("id", numbers.safe_double(F.when(i % 3 == 0, F.col("hedges").cast("string")).when(i % 3 == 1, "3.7").otherwise("n/a"), -1.0).alias("d"),
                                numbers.safe_int(F.when(i % 3 == 0, "0").when(i % 3 == 1, "3.7x"), 9).alias("i"))


@query("h47_colour_band", "SELECT id, CASE WHEN tone >= 0.75::DOUBLE THEN 'green' WHEN tone >= 0.55::DOUBLE THEN 'light' WHEN tone >= 0.35::DOUBLE THEN 'amber' ELSE 'red' END AS band, printf('%+d', defensive - 5) AS delta FROM sig")
def _(s, d):
    return signals(s, d).select("id", numbers.colour_band(F.col("tone")).alias("band"), F.format_string("%+d", F.col("defensive") - 5).alias("delta"))


@query("h48_token_cost", "SELECT id, round(defensive / 1e6 * 2.5::DOUBLE + superlatives / 1e6 * 10::DOUBLE, 12) AS cost FROM sig")
def _(s, d):
    return signals(s, d).select("id", F.round(numbers.token_cost(F.col("defensive"), F.col("superlatives"), F.lit(2.5), F.lit(10.0)), 12).alias("cost"))


@query("h49_reasoning_prefix", "SELECT p_partkey, starts_with(lower(p_name), 'a') OR starts_with(lower(p_name), 'pa') AS reasoning FROM part")
def _(s, d):
    n = F.lower("p_name")
    return table(s, d, "part").select("p_partkey", (n.startswith("a") | n.startswith("pa")).alias("reasoning"))


@query("h50_json_encode", """SELECT id, '{"quarter":"' || quarter || '","year":' || fiscal_year || ',"none":null}' AS j FROM sig""")
def _(s, d):
    return signals(s, d).select("id", jsonfn.encode(F.struct("quarter", F.col("fiscal_year").alias("year"), F.lit(None).cast("string").alias("none"))).alias("j"))


@query("h51_json_decode", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events")
def _(s, d):
    raw = F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.col("props"))
    return table(s, d, "events").select("event_id", jsonfn.decode(raw, "k long")["k"].alias("k"))


@query("h52_json_repair", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(s, d):
    fenced = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```"))
    return table(s, d, "events").select("event_id", jsonfn.payload(fenced, "k long")["k"].alias("k"))


@query("h53_nested_get", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(s, d):
    nested = F.parse_json(F.concat(F.lit('{"a":{"b":'), "props", F.lit("}}")))
    return table(s, d, "events").select("event_id", F.try_variant_get(nested, "$.a.b.k", "bigint").alias("k"))


@query("h56_token_usage", "SELECT event_id, event_id % 100 AS input, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 0 END::BIGINT AS output FROM events")
def _(s, d):
    n = (F.col("event_id") % 100).cast("string")
    shape = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"usage":{"prompt_tokens":'), n, F.lit(',"completion_tokens":7}}'))).otherwise(F.concat(F.lit('{"usage":{"input_tokens":'), n, F.lit("}}")))
    return table(s, d, "events").select("event_id", jsonfn.token_usage(shape).alias("u")).select("event_id", "u.input", "u.output")
