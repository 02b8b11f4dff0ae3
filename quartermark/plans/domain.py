"""Stand-ins: the engine's tables built from the star-schema tables, and the same in SQL.

``CTES`` holds each stand-in as SQL; ``sql(body)`` puts those that a body names before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None):
    """Register a query, with its SQL if it has one."""

    def register(f):
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = sql(body)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fiscal(date: str) -> str:
    """SQL of quarter number, fiscal year and period index of a date column."""
    q = f"(((month({date}) + 8) % 12) // 3 + 1)"
    fy = f"(year({date}) + CASE WHEN month({date}) >= 4 THEN 1 ELSE 0 END)"
    return f"'Q' || {q} AS quarter, {fy}::INT AS fiscal_year, ({fy} * 4 + {q} - 1)::INT AS period_idx"


def with_fiscal(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date)
    return df.withColumns({"quarter": F.concat(F.lit("Q"), periods.quarter_number(d)), "fiscal_year": periods.fiscal_year(d), "period_idx": periods.period_idx(d)})


def signals(spark, d) -> DataFrame:
    """Scored periods as they arrive, repeats included: a row per order."""
    o = with_fiscal(table(spark, d, "orders"), "o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("ticker"), "quarter", "fiscal_year", "period_idx", F.col("o_orderdate").alias("generated_at"),
        ((k * 7919 % 1001) / 100).alias("score"), ((k % 201 - 100) / 100).alias("tone"), (k % 23).cast("double").alias("hedges"),
        F.col("o_orderstatus").alias("status"), (k % 11).alias("defensive"), (k % 5).alias("superlatives"), (k % 3 == 0).alias("wide"), (k % 7 == 0).alias("avoidance"), (k % 6).alias("evidence"))


def latest(spark, d) -> DataFrame:
    from ..operators.store import latest_wins

    return latest_wins(signals(spark, d))


#: What a signal of each kind does not have: confidence is there for every period.
LACKS = {1: "P", 2: "O", 3: "F"}


def kind(df: DataFrame, n: int) -> DataFrame:
    """The latest signals of kind ``n``: those whose status lets that kind be scored."""
    return df.where(F.col("status") != LACKS[n]) if n in LACKS else df


def kind_sql(n: int, name: str = "status") -> str:
    return f"{name} <> '{LACKS[n]}'" if n in LACKS else "TRUE"


#: What orders the lines of an order; (order, line number) alone repeats.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
ITEM_PERIOD = ("quarter", "fiscal_year", "period_idx")


def items(spark, d) -> DataFrame:
    """Guidance items: a row per order line."""
    li = with_fiscal(table(spark, d, "lineitem"), "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    outcome = F.when(F.col("l_returnflag") == "A", "beat").when(F.col("l_returnflag") == "N", "in_line").otherwise("miss")
    name = F.concat(F.lit("Metric "), (F.col("l_suppkey") % 7).cast("string"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("ticker"), *ITEM_PERIOD, *LINE, outcome.alias("outcome"),
        F.when(F.col("l_linenumber") % 2 == 0, F.upper(name)).otherwise(name).alias("metric"))


def guidance(spark, d) -> DataFrame:
    """A row a ticker and period: outcome counts and whether two misses stand in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "period_idx").orderBy(*LINE)
    rows = items(spark, d).withColumn("twice", (F.col("outcome") == "miss") & (F.lag("outcome").over(w) == "miss"))
    return rows.groupBy("ticker", "quarter", "fiscal_year", "period_idx").agg(
        F.count_if(F.col("outcome") == "beat").alias("beats"), F.count_if(F.col("outcome") == "in_line").alias("in_line"),
        F.count_if(F.col("outcome") == "miss").alias("misses"), F.count("*").alias("tracked"), F.coalesce(F.bool_or("twice"), F.lit(False)).alias("streak"))


def themes(spark, d) -> DataFrame:
    """Mentions of themes a ticker and period, with a sentiment from whole-number sums."""
    e = table(spark, d, "events")
    n = F.count("*")
    return e.groupBy((F.col("user_id") % 500).alias("ticker"), F.floor((F.dayofmonth("ts") - 1) / 8).cast("int").alias("period_idx"), F.col("event_type").alias("theme")).agg(
        n.alias("cur"), ((F.sum(F.col("event_id") % 41) - 20 * n) / (20 * n)).alias("sentiment"))


def theme_pairs(spark, d) -> DataFrame:
    t = themes(spark, d)
    prior = t.select("ticker", (F.col("period_idx") + 1).alias("period_idx"), "theme", F.col("cur").alias("prev"), F.col("sentiment").alias("prev_sentiment"))
    return t.join(prior, ["ticker", "period_idx", "theme"], "left").withColumns({
        "prior_available": F.col("prev").isNotNull(), "prev": F.coalesce("prev", F.lit(0)), "prev_sentiment": F.coalesce("prev_sentiment", F.lit(0.0))})


def docs(spark, d) -> DataFrame:
    """Ingested documents with a period each."""
    t = table(spark, d, "documents")
    idx = (F.col("doc_id") % 8 + 8100).cast("int")
    types = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "earnings_call", "fr", "annual_report", "de", "press_release", "es", "investor_presentation")]), F.col("lang"))
    return t.select("doc_id", F.col("source").alias("ticker"), types.alias("doc_type"), idx.alias("period_idx"), F.concat(F.lit("Q"), F.pmod(idx, F.lit(4)) + 1).alias("quarter"),
                    F.floor(idx / 4).cast("int").alias("fiscal_year"), F.concat(F.lit("https://f/"), (F.col("doc_id") % 97).cast("string")).alias("source_url"), "text")


def lines(spark, d) -> DataFrame:
    """Chunks: the lines of documents that are longer than 50 characters."""
    t = docs(spark, d).select("doc_id", "ticker", "doc_type", "period_idx", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    chunk = F.substring(F.md5(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.substring("line", 1, 40)).cast("binary")), 1, 16)
    return t.where(F.length("line") > 50).withColumn("chunk_id", chunk)


def announcements(spark, d) -> DataFrame:
    return announcements_of(table(spark, d, "orders"))


def announcements_of(o: DataFrame) -> DataFrame:
    """Filings in every shape of subject, from orders."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS")
    idx = periods.period_idx(date)
    subject = (
        F.when(k % 8 == 0, F.concat(F.lit("Financial Results for the quarter ended "), F.date_format(date, "MMMM d, yyyy")))
        .when(k % 8 == 1, F.concat(F.lit("Audited financial results for year ended "), F.date_format(date, "dd.MM.yyyy")))
        .when(k % 8 == 2, F.concat(F.lit("Investor Presentation "), periods.quarter_of(idx), F.lit(" FY"), F.lpad(F.pmod(periods.year_of(idx), F.lit(100)).cast("string"), 2, "0")))
        .when(k % 8 == 3, F.lit("Transcript of earnings call"))
        .when(k % 8 == 4, F.lit("Annual Report 2024-25"))
        .when(k % 8 == 5, F.lit("Newspaper publication"))
        .when(k % 8 == 6, F.concat(F.lit("Press Release quarter ended "), F.date_format(date, "dd"), F.lit("th "), F.date_format(date, "MMM, yyyy")))
        .otherwise(F.lit("Closure of trading window")))
    return o.select(k.alias("ordinal"), F.col("o_custkey").alias("ticker"), F.when(k % 2 == 0, "NSE").otherwise("BSE").alias("source"), subject.alias("subject"),
                    F.concat(F.lit("https://x/"), F.col("o_custkey").cast("string"), F.lit("/"), (k % 50).cast("string"), F.lit(".pdf")).alias("url"),
                    F.when(k % 13 != 0, date).alias("event_date"))


#: What the stored signals of each kind bear beside their keys, and the same in SQL.
PAYLOAD = {
    "confidence": {"score": "score", "tone_label": "status", "reliability": "CASE WHEN wide THEN 'low' ELSE 'high' END", "summary": "'tone ' || status"},
    "narrative": {"overall_shift": "CASE WHEN wide THEN 'positive' ELSE 'mixed' END", "summary": "'shift of ' || status"},
    "guidance": {"score": "round(score * 10)", "beats": "cast(defensive as int)", "misses": "cast(superlatives as int)", "in_line": "cast(evidence as int)", "serial_miss_risk": "avoidance", "summary": "'kept ' || status"},
    "risk": {"direction": "CASE WHEN avoidance THEN 'increasing' ELSE 'stable' END", "summary": "'risk of ' || status"},
}


def stored(spark, d, kind_name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a kind as they are first stored, and those that replace some of them a day later."""
    n = list(PAYLOAD).index(kind_name)
    t = signals(spark, d)
    key = F.concat(F.lit(f"{kind_name}::"), F.col("id").cast("string")).alias("id")
    names = [F.expr(sql_).alias(c) for c, sql_ in PAYLOAD[kind_name].items()]
    row = [key, F.col("ticker").cast("string").alias("ticker"), F.lit("Company").alias("company"), "quarter", "fiscal_year"]
    lists = {"confidence": [F.array(F.col("status")).alias("drivers")], "risk": [F.array(F.col("status")).alias("new_risks"), F.array(F.lit("fx")).alias("escalating"), F.array(F.lit("fx"), F.col("status")).alias("diminishing"),
             F.array(F.struct(F.col("status").alias("risk"), F.when(F.col("wide"), "high").otherwise("low").alias("severity"))).alias("risks")]}.get(kind_name, [])
    later = t.where(F.col("status") == LACKS[n % 3 + 1]).withColumn("status", F.lit("again")).withColumn("generated_at", F.col("generated_at") + F.expr("INTERVAL 1 DAY"))
    return tuple(x.select(*row, "generated_at", *names, *lists) for x in (t, later))


def stored_sql(kind_name: str) -> str:
    """The latest stored rows of a kind."""
    n = list(PAYLOAD).index(kind_name)
    names = ", ".join(f"{sql_} AS {c}" for c, sql_ in PAYLOAD[kind_name].items())
    row = f"'{kind_name}::' || id AS id, ticker::VARCHAR AS ticker, quarter, fiscal_year, period_idx, generated_at, status, wide, {names}"
    again = f"SELECT * REPLACE ('again' AS status, generated_at + INTERVAL 1 DAY AS generated_at) FROM sig WHERE status = '{LACKS[n % 3 + 1]}'"
    both = f"SELECT {row} FROM (SELECT * FROM sig UNION ALL {again})"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, quarter, fiscal_year ORDER BY generated_at DESC, id DESC) AS rn FROM ({both})) WHERE rn = 1)"


def store_of(spark, d, *kinds: str, documents: bool = False):
    """A store in the shared folder with the rows of some kinds, in two upserts each, and the documents."""
    from ..operators.store import SignalStore, shared_folder

    made = SignalStore(spark, shared_folder(spark, "signal-store"))
    for k in kinds:
        for rows in stored(spark, d, k):
            made.upsert(f"{k}_signals", rows.withColumn("score", F.col("score").cast("double")) if "score" in rows.columns else rows)
    if documents:
        t = docs(spark, d).withColumns({"doc_id": F.col("doc_id").cast("string"), "ticker": F.upper("ticker"), "raw_text": F.col("text"), "ingested_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
        made.upsert("ingested_documents", t.drop("text", "period_idx"))
    return made


CTES = {
    "sig": f"""SELECT o_orderkey AS id, o_custkey AS ticker, {fiscal('o_orderdate')}, o_orderdate AS generated_at,
  (o_orderkey * 7919 % 1001)::DOUBLE / 100 AS score, (o_orderkey % 201 - 100)::DOUBLE / 100 AS tone, (o_orderkey % 23)::DOUBLE AS hedges,
  o_orderstatus AS status, o_orderkey % 11 AS defensive, o_orderkey % 5 AS superlatives, o_orderkey % 3 = 0 AS wide, o_orderkey % 7 = 0 AS avoidance, o_orderkey % 6 AS evidence FROM orders""",
    "latest": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, quarter, fiscal_year ORDER BY generated_at DESC NULLS LAST, id DESC) AS rn FROM sig) WHERE rn = 1""",
    "items": f"""SELECT o_custkey AS ticker, {fiscal('l_shipdate')}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_returnflag WHEN 'A' THEN 'beat' WHEN 'N' THEN 'in_line' ELSE 'miss' END AS outcome,
  CASE WHEN l_linenumber % 2 = 0 THEN upper('Metric ' || (l_suppkey % 7)) ELSE 'Metric ' || (l_suppkey % 7) END AS metric
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "guid": """SELECT ticker, quarter, fiscal_year, period_idx, count_if(outcome = 'beat')::BIGINT AS beats, count_if(outcome = 'in_line')::BIGINT AS in_line,
  count_if(outcome = 'miss')::BIGINT AS misses, count(*) AS tracked, coalesce(bool_or(outcome = 'miss' AND before = 'miss'), FALSE) AS streak
  FROM (SELECT *, lag(outcome) OVER (PARTITION BY ticker, period_idx ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM items) GROUP BY ALL""",
    "themes": """SELECT user_id % 500 AS ticker, ((day(ts) - 1) // 8)::INT AS period_idx, event_type AS theme, count(*) AS cur,
  (sum(event_id % 41)::BIGINT - 20 * count(*))::DOUBLE / (20 * count(*)) AS sentiment FROM events GROUP BY ALL""",
    "pairs": """SELECT t.*, p.cur IS NOT NULL AS prior_available, coalesce(p.cur, 0) AS prev, coalesce(p.sentiment, 0.0)::DOUBLE AS prev_sentiment
  FROM themes t LEFT JOIN themes p ON p.ticker = t.ticker AND p.theme = t.theme AND p.period_idx = t.period_idx - 1""",
    "docs": """SELECT doc_id, source AS ticker, CASE lang WHEN 'en' THEN 'earnings_call' WHEN 'fr' THEN 'annual_report' WHEN 'de' THEN 'press_release' WHEN 'es' THEN 'investor_presentation' END AS doc_type,
  (doc_id % 8 + 8100)::INT AS period_idx, 'Q' || ((doc_id % 8 + 8100) % 4 + 1) AS quarter, ((doc_id % 8 + 8100) // 4)::INT AS fiscal_year, 'https://f/' || (doc_id % 97) AS source_url, text FROM documents""",
    "lines": """SELECT *, substr(md5(doc_id || '::' || pos || '::' || substr(line, 1, 40)), 1, 16) AS chunk_id FROM (
  SELECT doc_id, ticker, doc_type, period_idx, (unnest(range(1, len(parts) + 1)) - 1)::INT AS pos, unnest(parts) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM docs)) WHERE length(line) > 50""",
    "ann": f"""SELECT o_orderkey AS ordinal, o_custkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS source,
  CASE o_orderkey % 8 WHEN 0 THEN 'Financial Results for the quarter ended ' || strftime(day, '%B %-d, %Y')
  WHEN 1 THEN 'Audited financial results for year ended ' || strftime(day, '%d.%m.%Y')
  WHEN 2 THEN 'Investor Presentation ' || quarter || ' FY' || lpad((fiscal_year % 100)::VARCHAR, 2, '0')
  WHEN 3 THEN 'Transcript of earnings call' WHEN 4 THEN 'Annual Report 2024-25' WHEN 5 THEN 'Newspaper publication'
  WHEN 6 THEN 'Press Release quarter ended ' || strftime(day, '%dth %b, %Y') ELSE 'Closure of trading window' END AS subject,
  'https://x/' || o_custkey || '/' || (o_orderkey % 50) || '.pdf' AS url, CASE WHEN o_orderkey % 13 <> 0 THEN day END AS event_date
  FROM (SELECT *, {fiscal('day')} FROM (SELECT *, o_orderdate + INTERVAL 20 YEAR AS day FROM orders))""",
    "annp": """SELECT *, CASE WHEN doc_type = 'annual_report' THEN NULL ELSE named END AS by_subject FROM (
  SELECT *, CASE ordinal % 8 WHEN 3 THEN 'earnings_call' WHEN 2 THEN 'investor_presentation' WHEN 4 THEN 'annual_report' WHEN 0 THEN 'press_release' WHEN 1 THEN 'press_release' WHEN 6 THEN 'press_release' END AS doc_type,
  CASE WHEN ordinal % 8 IN (0, 1, 2, 6) THEN subject_idx END AS named, event_idx - 1 AS by_date FROM (
    SELECT ann.*, s.period_idx + 80 AS subject_idx, CASE WHEN ann.event_date IS NOT NULL THEN s.period_idx + 80 END AS event_idx FROM ann JOIN sig s ON s.id = ann.ordinal))""",
}


def sql(body: str) -> str:
    """``body`` after the stand-ins that it needs; a body that has them already stays as it is."""
    if any(f"{n} AS ({c})" in body for n, c in CTES.items()):
        return body
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"(?i)\b(from|join|in)\s+\(?{name}\b|,\s*{name}\b(?!\.|\))", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    heads = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = body.strip()
    if not heads:
        return body
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
