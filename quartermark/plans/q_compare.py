"""Joins over periods, evidence joins and the consistency checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods, text
from ..operators import aggregates, compare, scoring, store, validate
from .domain import announcements, docs, guidance, items, kind, latest, lines, query, signals, table, theme_pairs, themes

K = ["ticker", "period_idx"]


@query("c01_bundle", """SELECT c.ticker, c.period_idx, c.score AS confidence, n.score AS narrative, g.score AS guidance, r.score AS risk FROM latest c
LEFT JOIN latest n ON n.ticker = c.ticker AND n.period_idx = c.period_idx AND n.status <> 'P' LEFT JOIN latest g ON g.ticker = c.ticker AND g.period_idx = c.period_idx AND g.status <> 'O'
LEFT JOIN latest r ON r.ticker = c.ticker AND r.period_idx = c.period_idx AND r.status <> 'F'""")
def _(s, d):
    t = latest(s, d).select(*K, "status", "score")
    others = {n: kind(t, i + 1).drop("status") for i, n in enumerate(("narrative", "guidance", "risk"))}
    b = compare.bundle(kind(t, 0).drop("status").withColumnRenamed("score", "confidence"), others)
    return b.select(*K, "confidence", *[F.col(f"{n}.score").alias(n) for n in others])


COMPARE = """SELECT a.ticker, a.period_idx, a.score, q.score AS score_qoq, y.score AS score_yoy FROM latest a LEFT JOIN latest q ON q.ticker = a.ticker AND q.period_idx = a.period_idx - 1
LEFT JOIN latest y ON y.ticker = a.ticker AND y.period_idx = a.period_idx - 4"""


@query("c02_latest_qoq_yoy", COMPARE)
def _(s, d):
    return compare.comparison(latest(s, d).select(*K, "score"), ["score"])


@query("c03_gap_safe_delta", "SELECT a.ticker, a.period_idx, a.score, a.score - q.score AS score_delta FROM latest a LEFT JOIN latest q ON q.ticker = a.ticker AND q.period_idx = a.period_idx - 1")
def _(s, d):
    return compare.gap_safe_delta(latest(s, d).select(*K, "score"), "score")


@query("c04_all_periods", "SELECT c.ticker, c.quarter || ' FY' || lpad((c.fiscal_year % 100)::VARCHAR, 2, '0') AS label, c.score, g.beats, g.misses FROM latest c LEFT JOIN guid g ON g.ticker = c.ticker AND g.period_idx = c.period_idx")
def _(s, d):
    g = guidance(s, d).select(*K, "beats", "misses")
    return latest(s, d).join(g, K, "left").select("ticker", periods.format_period(F.col("quarter"), F.col("fiscal_year")).alias("label"), "score", "beats", "misses")


@query("c05_fuzzy_prior")
def _(s, d):
    """Themes under slightly changed names against the names of the period before."""
    t = themes(s, d)
    cur = t.select("ticker", "period_idx", F.concat("theme", F.lit(" growths")).alias("name"), "cur")
    prior = t.select("ticker", (F.col("period_idx") + 1).alias("period_idx"), F.concat("theme", F.lit(" growth")).alias("name"), F.xxhash64("theme").alias("pos"))
    return compare.match_prior(cur, prior, "name", K, "pos").select("ticker", "period_idx", "name", "matched")


@query("c06_theme_baseline", "SELECT ticker, period_idx, theme, cur, prev, sentiment, prev_sentiment, prior_available FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select(*K, "theme", "cur", "prev", "sentiment", "prev_sentiment", "prior_available")


@query("c07_risk_baseline", "SELECT ticker, period_idx, theme AS risk, cur, prev, CASE WHEN prev = 0 AND cur > 0 THEN 'newly_material' WHEN cur = 0 AND prev > 0 THEN 'diminishing' WHEN prev > 0 AND cur * 2 >= prev * 3 THEN 'escalating' WHEN prev > 0 AND cur * 3 <= prev * 2 THEN 'diminishing' ELSE 'stable' END AS status FROM pairs")
def _(s, d):
    return theme_pairs(s, d).select(*K, F.col("theme").alias("risk"), "cur", "prev", scoring.risk_status(F.col("cur"), F.col("prev")).alias("status"))


THEME_STATUS = """CASE WHEN sentiment <= -0.2 AND sentiment < prev_sentiment THEN 'newly_risky' WHEN prev <= 1 AND cur >= 2 THEN 'emerging' WHEN cur = 0 OR (prev > 0 AND cur::DOUBLE / prev <= 0.5) THEN 'fading'
WHEN (prev <= 0 OR cur::DOUBLE / prev >= 1.5) AND sentiment > 0 THEN 'accelerating' ELSE 'stable' END"""


@query("c08_recomputed_shift", f"""WITH st AS (SELECT ticker, period_idx, {THEME_STATUS} AS status FROM pairs), n AS (SELECT ticker, period_idx, count_if(status IN ('accelerating', 'emerging'))::BIGINT AS pos, count_if(status IN ('fading', 'newly_risky'))::BIGINT AS neg FROM st GROUP BY 1, 2)
SELECT *, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' WHEN pos > 0 THEN 'mixed' ELSE 'neutral' END AS shift FROM n""")
def _(s, d):
    t = theme_pairs(s, d)
    status = scoring.theme_status(*[F.col(c) for c in ("cur", "prev", "sentiment", "prev_sentiment")])
    n = t.select(*K, status.alias("status")).groupBy(*K).agg(F.count_if(F.col("status").isin("accelerating", "emerging")).alias("pos"), F.count_if(F.col("status").isin("fading", "newly_risky")).alias("neg"))
    return n.withColumn("shift", scoring.overall_shift(F.col("pos"), F.col("neg")))


@query("c09_theme_sentiment_table", """SELECT a.ticker, a.period_idx, a.theme, round(a.sentiment - b.sentiment, 6) AS d1, round(a.sentiment - c.sentiment, 6) AS d2 FROM themes a LEFT JOIN themes b ON b.ticker = a.ticker AND b.theme = a.theme AND b.period_idx = a.period_idx - 1
LEFT JOIN themes c ON c.ticker = a.ticker AND c.theme = a.theme AND c.period_idx = a.period_idx - 2""")
def _(s, d):
    t = themes(s, d).select(*K, "theme", "sentiment")
    out = t
    for n in (1, 2):
        prior = t.select("ticker", (F.col("period_idx") + n).alias("period_idx"), "theme", F.col("sentiment").alias(f"s{n}"))
        out = out.join(prior, [*K, "theme"], "left")
    return out.select(*K, "theme", *[F.round(F.col("sentiment") - F.col(f"s{n}"), 6).alias(f"d{n}") for n in (1, 2)])


@query("c10_period_coverage", """SELECT coalesce(c.ticker, g.ticker) AS ticker, coalesce(c.period_idx, g.period_idx) AS period_idx, c.ticker IS NOT NULL AS has_confidence, g.ticker IS NOT NULL AS has_guidance FROM latest c FULL JOIN guid g ON g.ticker = c.ticker AND g.period_idx = c.period_idx""")
def _(s, d):
    return compare.coverage({"confidence": latest(s, d), "guidance": guidance(s, d)})


@query("c11_missing_kinds", """WITH want AS (SELECT ticker, max(period_idx) AS m FROM latest GROUP BY 1), w AS (SELECT ticker, (m - unnest([0, 1, 4]))::INT AS period_idx FROM want), k AS (SELECT *, unnest(['confidence', 'guidance']) AS kind FROM w)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE k.kind = 'confidence' AND l.ticker = k.ticker AND l.period_idx = k.period_idx) AND NOT EXISTS (SELECT 1 FROM guid g WHERE k.kind = 'guidance' AND g.ticker = k.ticker AND g.period_idx = k.period_idx)""")
def _(s, d):
    t = latest(s, d)
    want = t.groupBy("ticker").agg(F.max("period_idx").alias("m")).select("ticker", F.explode(F.array(F.col("m"), F.col("m") - 1, F.col("m") - 4)).alias("period_idx"))
    return compare.missing_kinds(want, {"confidence": t, "guidance": guidance(s, d)})


@query("c12_document_coverage", """WITH n AS (SELECT o_custkey AS ticker, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS ticker, coalesce(n.n, 0) AS n_docs, CASE WHEN coalesce(n.n, 0) = 0 THEN 'FAIL' WHEN n.n = 1 THEN 'WARN' ELSE 'PASS' END AS status FROM customer LEFT JOIN n ON n.ticker = c_custkey""")
def _(s, d):
    n = table(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("ticker")).agg(F.count("*").alias("n"))
    out = table(s, d, "customer").select(F.col("c_custkey").alias("ticker")).join(n, "ticker", "left").withColumn("n_docs", F.coalesce("n", F.lit(0)))
    return out.select("ticker", "n_docs", F.when(F.col("n_docs") == 0, "FAIL").when(F.col("n_docs") == 1, "WARN").otherwise("PASS").alias("status"))


@query("c13_containment", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0")
def _(s, d):
    return compare.contained(table(s, d, "benchmark"), "text", table(s, d, "documents").select("doc_id", "text"), "text", "item_id", "doc_id")


@query("c15_evidence_verify", "SELECT chunk_id, doc_id, pos, pos % 3 <> 0 AND length(line) >= 30 AS verified FROM lines")
def _(s, d):
    from ..operators.pipeline import verified

    c = lines(s, d).dropDuplicates(["chunk_id"]).select("chunk_id", F.col("line").alias("text"))
    asked = lines(s, d).select("chunk_id", "doc_id", "pos", F.when(F.col("pos") % 3 != 0, F.substring("line", 1, 30)).otherwise("no such words").alias("quote"))
    good, dropped = verified(asked, c)
    return good.select("chunk_id", "doc_id", "pos", F.lit(True).alias("verified")).unionByName(dropped.select("chunk_id", "doc_id", "pos", F.lit(False).alias("verified")))


SHARED = "WITH c AS (SELECT DISTINCT ticker, period_idx, md5(line) AS chunk FROM lines) SELECT a.ticker, a.period_idx, b.period_idx AS other_idx, count(*) AS shared FROM c a JOIN c b ON a.ticker = b.ticker AND a.chunk = b.chunk AND a.period_idx < b.period_idx GROUP BY 1, 2, 3"


@query("c16_shared_evidence", SHARED)
def _(s, d):
    return validate.shared_evidence(lines(s, d).select("ticker", "period_idx", F.md5(F.col("line").cast("binary")).alias("chunk_id")))


@query("c17_new_chunks", "SELECT DISTINCT chunk_id FROM lines WHERE chunk_id NOT IN (SELECT chunk_id FROM lines WHERE doc_type = 'earnings_call')")
def _(s, d):
    return store.new_rows(lines(s, d), lines(s, d).where("doc_type = 'earnings_call'"), "chunk_id").select("chunk_id")


@query("c18_prune", "SELECT chunk_id, doc_id FROM lines WHERE doc_type <> 'annual_report'")
def _(s, d):
    return store.prune(lines(s, d), docs(s, d).where("doc_type <> 'annual_report'")).select("chunk_id", "doc_id")


@query("c19_not_in_delete", "SELECT id FROM sig WHERE id NOT IN (SELECT id FROM latest)")
def _(s, d):
    return signals(s, d).select("id").join(latest(s, d).select("id"), "id", "left_anti")


CITED = """SELECT id, CASE WHEN id % 2 = 0 THEN 'guidance' ELSE 'confidence' END AS kind, ticker, period_idx, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN period_idx - 1 ELSE period_idx END AS cited_idx FROM latest"""


def citations(s, d):
    i = F.col("id")
    return latest(s, d).select(i, F.when(i % 2 == 0, "guidance").otherwise("confidence").alias("kind"), "ticker", "period_idx",
                               F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, F.col("period_idx") - 1).otherwise(F.col("period_idx")).cast("int").alias("cited_idx"))


M01 = f"""WITH c AS ({CITED}) SELECT id, CASE WHEN cited_idx IS NULL THEN 'WARN' ELSE 'FAIL' END AS status FROM c
WHERE cited_idx IS NULL OR (kind <> 'guidance' AND cited_idx <> period_idx) OR (kind = 'guidance' AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.ticker = c.ticker AND l.period_idx = c.cited_idx))"""


@query("c20_cited_periods", M01)
def _(s, d):
    return validate.citation_periods(citations(s, d), latest(s, d)).select("id", "status")


def _sector_sql() -> str:
    """The sector of a part, whose name ends in a word of the dimension, from a table of (place, sector, word)."""
    rows = ", ".join(f"({i}, '{label}', '{word.replace(chr(39), chr(39) * 2)}')" for i, (label, words) in enumerate(text.SECTORS) for word in words)
    named = f"SELECT p_partkey, lower(p_name || ' ' || w.word) AS p FROM part JOIN (SELECT row_number() OVER (ORDER BY place, word) - 1 AS n, word FROM (VALUES {rows}) v(place, sector, word)) w ON w.n = p_partkey % {sum(len(w) for _, w in text.SECTORS)}"
    return f"SELECT p_partkey, coalesce((SELECT min_by(v.sector, v.place) FROM (VALUES {rows}) v(place, sector, word) WHERE contains(n.p, v.word)), 'general') AS sector FROM ({named}) n"


@query("c21_sector", _sector_sql())
def _(s, d):
    words = sorted((i, w) for i, (_, ws) in enumerate(text.SECTORS) for w in ws)
    names = F.array(*[F.lit(w) for _, w in words])
    p = table(s, d, "part").withColumn("name", F.concat_ws(" ", "p_name", F.get(names, (F.col("p_partkey") % len(words)).cast("int"))))
    return p.select("p_partkey", text.sector(F.col("name")).alias("sector"))


@query("c22_last_ended_quarter", "SELECT ordinal, event_idx - 1 AS period_idx FROM (SELECT ann.ordinal, s.period_idx + 80 AS event_idx FROM ann JOIN sig s ON s.id = ann.ordinal WHERE event_date IS NOT NULL)")
def _(s, d):
    return announcements(s, d).where("event_date is not null").select("ordinal", periods.last_ended(F.col("event_date")).alias("period_idx"))


@query("c23_search_window_join", """SELECT id, w.p AS window_idx FROM sig JOIN (VALUES (7988, TIMESTAMP '1996-04-01', TIMESTAMP '1996-09-28 23:59:59'), (7990, TIMESTAMP '1996-10-01', TIMESTAMP '1997-03-31 23:59:59')) w(p, a, b) ON generated_at BETWEEN w.a AND w.b""")
def _(s, d):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    w = s.createDataFrame([(7988,), (7990,)], "window_idx int").select("window_idx", periods.search_window(F.col("window_idx"), now).alias("w"))
    t = signals(s, d).select("id", "generated_at")
    return t.join(F.broadcast(w), F.col("generated_at").between(F.col("w.start"), F.col("w.end"))).select("id", "window_idx")


@query("c24_price_prefix", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 0.15::DOUBLE WHEN 2 THEN 2.5::DOUBLE END AS price_in FROM lineitem")
def _(s, d):
    from .q_store import calls

    return calls(s, d).select(F.floor(F.col("call_id") / 10).alias("l_orderkey"), (F.col("call_id") % 10).cast("int").alias("l_linenumber"), "price_in")


@query("c25_reuse_gate", "SELECT id, wide AND NOT avoidance AS reused FROM latest")
def _(s, d):
    t = latest(s, d).select("id", "wide", "avoidance", "ticker", "quarter", "fiscal_year", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("fingerprint"))
    runs = t.withColumn("fingerprint", F.when(F.col("wide"), F.col("fingerprint")).otherwise("stale")).drop("id")
    reuse, score = store.reuse_gate(t, runs, t.where("not avoidance"))
    return reuse.select("id", F.lit(True).alias("reused")).union(score.select("id", F.lit(False)))


@query("c14_longest_prefix", """WITH RECURSIVE q AS (SELECT item_id, text || ' §' AS quote FROM benchmark UNION ALL SELECT item_id + 1000000, substr(text, 1, 4 + item_id % 40) || '§' || substr(text, 60) FROM benchmark),
step AS (SELECT item_id, quote, 0 AS low, length(quote) AS high, 0 AS round FROM q UNION ALL
SELECT s.item_id, s.quote, CASE WHEN s.ok THEN s.middle ELSE s.low END, CASE WHEN s.ok THEN s.high ELSE s.middle - 1 END, s.round + 1
FROM (SELECT *, (low + high + 1) // 2 AS middle, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, substr(step.quote, 1, (step.low + step.high + 1) // 2))) AS ok FROM step WHERE low < high) s)
SELECT e.item_id, e.low::INT AS prefix, (SELECT min(doc_id) FROM documents d WHERE e.low > 0 AND contains(d.text, substr(e.quote, 1, e.low))) AS doc_id FROM step e WHERE e.low = e.high""")
def _(s, d):
    """For benchmark texts with a changed end, and with a changed early place: the longest prefix that any document has."""
    b = table(s, d, "benchmark")
    early = F.concat(F.expr("substring(text, 1, cast(4 + item_id % 40 as int))"), F.lit("§"), F.expr("substring(text, 60)"))
    q = b.select("item_id", F.concat("text", F.lit(" §")).alias("quote")).union(b.select(F.col("item_id") + 1000000, early))
    return compare.longest_prefix(q, "quote", table(s, d, "documents").select("doc_id", "text"), "text", "item_id", "doc_id")


# --- D27, D28, M ------------------------------------------------------------------------

@query("d27_theme_rollup", f"""WITH st AS (SELECT ticker, period_idx, theme, {THEME_STATUS} AS status FROM pairs)
SELECT ticker, period_idx, coalesce(string_agg(theme, ',' ORDER BY theme) FILTER (WHERE status = 'accelerating'), '') AS accelerating, coalesce(string_agg(theme, ',' ORDER BY theme) FILTER (WHERE status = 'emerging'), '') AS emerging FROM st GROUP BY 1, 2""")
def _(s, d):
    status = scoring.theme_status(*[F.col(c) for c in ("cur", "prev", "sentiment", "prev_sentiment")])
    t = theme_pairs(s, d).select(*K, "theme", status.alias("status"))

    def names(label):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == label, F.col("theme")))), ",").alias(label)

    return t.groupBy(*K).agg(names("accelerating"), names("emerging"))


@query("d28_risk_rollup", """WITH st AS (SELECT ticker, period_idx, CASE WHEN prev = 0 THEN 'newly_material' WHEN cur * 2 >= prev * 3 THEN 'escalating' WHEN cur * 3 <= prev * 2 THEN 'diminishing' ELSE 'stable' END AS status FROM pairs),
n AS (SELECT ticker, period_idx, count_if(status IN ('newly_material', 'escalating'))::BIGINT AS up, count_if(status = 'diminishing')::BIGINT AS down FROM st GROUP BY 1, 2) SELECT *, CASE WHEN up > down THEN 'increasing' WHEN down > up THEN 'decreasing' ELSE 'stable' END AS direction FROM n""")
def _(s, d):
    t = theme_pairs(s, d).select(*K, scoring.risk_status(F.col("cur"), F.col("prev")).alias("status"))
    n = t.groupBy(*K).agg(F.count_if(F.col("status").isin("newly_material", "escalating")).alias("up"), F.count_if(F.col("status") == "diminishing").alias("down"))
    return n.withColumn("direction", scoring.risk_direction(F.col("up"), F.col("down")))


@query("m01_citation_periods", f"""WITH c AS ({CITED}), bad AS (SELECT kind, CASE WHEN cited_idx IS NULL THEN 'WARN' ELSE 'FAIL' END AS status FROM c
WHERE cited_idx IS NULL OR (kind <> 'guidance' AND cited_idx <> period_idx) OR (kind = 'guidance' AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.ticker = c.ticker AND l.period_idx = c.cited_idx)))
SELECT kind, status, count(*) AS n FROM bad GROUP BY 1, 2""")
def _(s, d):
    return validate.citation_periods(citations(s, d), latest(s, d)).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("m02_disjoint_evidence", f"SELECT count(*) AS pairs, coalesce(sum(shared), 0)::BIGINT AS shared FROM ({SHARED})".replace("FROM (WITH c AS", "FROM (WITH c AS"))
def _(s, d):
    found = validate.shared_evidence(lines(s, d).select("ticker", "period_idx", F.md5(F.col("line").cast("binary")).alias("chunk_id")))
    return found.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"))


@query("m03_unverified_quotes", "SELECT item_id AS quote_id FROM benchmark b WHERE length(b.text) >= 20 AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def _(s, d):
    quotes = table(s, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return validate.unverified_quotes(quotes, table(s, d, "documents").select("doc_id", "text")).select("quote_id")


@query("m04_one_doc_one_period", "SELECT source_url, count(DISTINCT period_idx) AS n_periods FROM docs WHERE source_url <> '' GROUP BY 1 HAVING count(DISTINCT period_idx) > 1")
def _(s, d):
    return validate.urls_in_two_periods(docs(s, d))


@query("m05_guidance_arithmetic", """WITH g AS (SELECT *, CASE WHEN period_idx % 5 = 0 THEN 0.5 ELSE beats::DOUBLE / tracked END AS beat_rate FROM guid) SELECT ticker, period_idx, 'beat rate' AS problem FROM g WHERE abs(beat_rate - beats::DOUBLE / tracked) > 0.01""")
def _(s, d):
    g = guidance(s, d).withColumns({"score": F.lit(50), "beat_rate": F.when(F.col("period_idx") % 5 == 0, 0.5).otherwise(F.col("beats") / F.col("tracked"))})
    return validate.guidance_arithmetic(g).select(*K, "problem")


@query("m06_theme_deltas", "SELECT ticker, period_idx, theme FROM pairs WHERE (ticker + period_idx) % 9 = 0")
def _(s, d):
    off = F.when((F.col("ticker") + F.col("period_idx")) % 9 == 0, 1).otherwise(0)
    t = theme_pairs(s, d).withColumns({"count_change": F.col("cur") - F.col("prev") + off, "sentiment_change": F.col("sentiment") - F.col("prev_sentiment")})
    return validate.theme_deltas(t).select(*K, "theme")


@query("m07_narrated_priors", "SELECT id, 'The score rose from ' || (id % 9) || '.0 to 7.5.' AS sentence FROM sig WHERE id % 6 = 0")
def _(s, d):
    i = F.col("id")
    told = F.concat(F.lit("A calm quarter. The score rose from "), (i % 9).cast("string"), F.lit(".0 to 7.5. Costs were up."))
    return validate.narrated_priors(signals(s, d).select("id", F.when(i % 6 == 0, told).otherwise("Costs rose from 5 to 6 percent. The score is 7.").alias("summary"))).select("id", "sentence")


@query("m08_stored_priors", "SELECT id FROM sig WHERE id % 10 = 3")
def _(s, d):
    return validate.stored_priors(signals(s, d).select("id", F.when(F.col("id") % 10 == 3, F.col("score")).alias("previous_score"))).select("id")


@query("m09_thin_coverage", """WITH n AS (SELECT ticker, period_idx, count(*) AS n FROM items WHERE outcome = 'miss' GROUP BY 1, 2) SELECT l.ticker, l.period_idx, coalesce(n.n, 0) AS n_docs, CASE WHEN n.n IS NULL THEN 'FAIL' ELSE 'WARN' END AS status FROM latest l LEFT JOIN n ON n.ticker = l.ticker AND n.period_idx = l.period_idx WHERE coalesce(n.n, 0) < 2""")
def _(s, d):
    return validate.thin_coverage(latest(s, d), items(s, d).where("outcome = 'miss'"))


def _report(s, d):
    t = latest(s, d)
    cites, pairs = citations(s, d), theme_pairs(s, d)
    quotes = table(s, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    moved = pairs.withColumns({"count_change": F.col("cur") - F.col("prev"), "sentiment_change": F.col("sentiment") - F.col("prev_sentiment")})
    g = guidance(s, d).withColumns({"score": F.lit(50), "beat_rate": F.col("beats") / F.col("tracked")})
    cited = lines(s, d).select("ticker", "period_idx", F.md5(F.col("line").cast("binary")).alias("chunk_id"))
    told = t.select("id", F.when(F.col("wide") & F.col("avoidance"), "The score fell from 7.0 to 6.5.").otherwise("Calm.").alias("summary"))
    parts = [
        ("citation periods", validate.citation_periods(cites, t), cites, "FAIL"),
        ("quotes verbatim", validate.unverified_quotes(quotes, table(s, d, "documents").select("doc_id", "text")), quotes, "FAIL"),
        ("one document one period", validate.urls_in_two_periods(docs(s, d)), docs(s, d), "FAIL"),
        ("guidance arithmetic", validate.guidance_arithmetic(g), g, "FAIL"),
        ("theme deltas", validate.theme_deltas(moved), moved, "FAIL"),
        ("stored priors", validate.stored_priors(t.withColumn("previous_score", F.lit(None).cast("double"))), t, "FAIL"),
        ("document coverage", validate.thin_coverage(t, items(s, d)), t, "FAIL"),
        ("disjoint evidence", validate.shared_evidence(cited), cited, "FAIL"),
        ("narrated priors", validate.narrated_priors(told), told, "FAIL"),
    ]
    return validate.report([validate.summarise(*p) for p in parts])


REPORT = f"""WITH found AS (
SELECT 'citation periods' AS name, count(*) AS items, count_if(status = 'FAIL') AS fails, (SELECT count(*) FROM latest) AS inputs FROM ({M01})
UNION ALL SELECT 'quotes verbatim', count(*), count(*), (SELECT count(*) FROM benchmark) FROM benchmark b WHERE length(b.text) >= 20 AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))
UNION ALL SELECT 'one document one period', count(*), count(*), (SELECT count(*) FROM docs) FROM (SELECT source_url FROM docs GROUP BY 1 HAVING count(DISTINCT period_idx) > 1)
UNION ALL SELECT 'guidance arithmetic', 0, 0, (SELECT count(*) FROM guid)
UNION ALL SELECT 'theme deltas', 0, 0, (SELECT count(*) FROM pairs)
UNION ALL SELECT 'stored priors', 0, 0, (SELECT count(*) FROM latest)
UNION ALL SELECT 'document coverage', count(*), count_if(n IS NULL), (SELECT count(*) FROM latest) FROM (SELECT x.n FROM latest l LEFT JOIN (SELECT ticker, period_idx, count(*) AS n FROM items GROUP BY 1, 2) x ON x.ticker = l.ticker AND x.period_idx = l.period_idx WHERE coalesce(x.n, 0) < 2)
UNION ALL SELECT 'disjoint evidence', count(*), count(*), (SELECT count(*) FROM lines) FROM ({SHARED})
UNION ALL SELECT 'narrated priors', count_if(wide AND avoidance), count_if(wide AND avoidance), count(*) FROM latest)
SELECT name AS "check", CASE WHEN inputs = 0 THEN 'SKIP' WHEN items = 0 THEN 'PASS' WHEN fails > 0 THEN 'FAIL' ELSE 'WARN' END AS status, items::BIGINT AS items FROM found"""


@query("m10_report", REPORT)
def _(s, d):
    return _report(s, d)[0]


@query("n16_verdict", f"""SELECT *, CASE WHEN fail > 0 THEN 'NOT TRUSTWORTHY' WHEN pass + warn < 3 THEN 'INCONCLUSIVE' WHEN warn > 0 THEN 'WARN' ELSE 'DEFENSIBLE' END AS verdict
FROM (SELECT count_if(status = 'PASS')::BIGINT AS pass, count_if(status = 'FAIL')::BIGINT AS fail, count_if(status = 'WARN')::BIGINT AS warn, count_if(status = 'SKIP')::BIGINT AS skip FROM ({REPORT}))""")
def _(s, d):
    return _report(s, d)[1]


@query("n10_comparison_triple", f"WITH c AS ({COMPARE}) SELECT c.* FROM c JOIN (SELECT ticker, max(period_idx) AS m FROM c GROUP BY 1) x ON x.ticker = c.ticker AND x.m = c.period_idx")
def _(s, d):
    return compare.latest_period(compare.comparison(latest(s, d).select(*K, "score"), ["score"]))


GUIDE_RAW = "CASE WHEN tracked > 0 THEN greatest(0.0, least(100.0, 100.0 * (beats * 1.0::DOUBLE + in_line * 0.8::DOUBLE + 1.5::DOUBLE) / (tracked + 3.0::DOUBLE) - CASE WHEN streak THEN 10 ELSE 0 END)) END"


def flagship(s, d):
    """Guidance credibility of each ticker's latest quarter with QoQ and YoY changes; not assessed stays null."""
    raw = scoring.guidance_raw(*[F.col(c) for c in ("beats", "in_line", "tracked", "streak")])
    g = guidance(s, d).select(*K, "quarter", "fiscal_year", F.round(raw, 4).alias("score"))
    c = compare.latest_period(compare.comparison(g, ["score"]))
    return c.select("ticker", "quarter", "fiscal_year", "score", F.round(F.col("score") - F.col("score_qoq"), 4).alias("qoq"), F.round(F.col("score") - F.col("score_yoy"), 4).alias("yoy"))


@query("flagship_guidance_credibility", f"""WITH g AS (SELECT ticker, quarter, fiscal_year, period_idx, round(({GUIDE_RAW})::DOUBLE, 4) AS score FROM guid), m AS (SELECT ticker, max(period_idx) AS p FROM g GROUP BY 1)
SELECT a.ticker, a.quarter, a.fiscal_year, a.score, round(a.score - q.score, 4) AS qoq, round(a.score - y.score, 4) AS yoy FROM g a JOIN m ON m.ticker = a.ticker AND m.p = a.period_idx LEFT JOIN g q ON q.ticker = a.ticker AND q.period_idx = a.period_idx - 1 LEFT JOIN g y ON y.ticker = a.ticker AND y.period_idx = a.period_idx - 4""")
def _(s, d):
    return flagship(s, d)
