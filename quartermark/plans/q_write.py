"""The write path over every document: two runs into one store, and what its tables then have.

Documents are filings of five quarters. A run in October scores three of them; one in January
scores its own three, reuses a quarter whose documents are the same, and takes its stored themes
and risks as the baseline of the next. The items that a model would give are a rule over the
filing's number here, so that SQL can say what has to be stored.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import periods
from ..operators import pipeline
from ..operators.store import SignalStore, shared_folder
from .domain import announcements_of, lines, query, table

QUARTERS = (8106, 8105, 8104, 8102, 8101)
RUNS = (dt.datetime(2025, 11, 1), dt.datetime(2026, 2, 1))
THEMES, RISKS = ("demand", "margins", "exports", "pricing"), ("fuel", "currency", "litigation", "weather")
SEVERITY, OUTCOME = ("low", "medium", "high", "critical"), ("beat", "miss", "in_line", "pending")


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def filings(spark, d) -> tuple[DataFrame, DataFrame]:
    """(announcements, texts): each document as an investor presentation whose subject names its quarter."""
    t = table(spark, d, "documents").where("doc_id is not null")
    idx = _pick(QUARTERS, F.floor(F.col("doc_id") / 20))
    subject = F.concat(F.lit("Investor Presentation "), periods.quarter_of(idx), F.lit(" FY"), F.lpad(F.pmod(periods.year_of(idx), F.lit(100)).cast("string"), 2, "0"))
    url = F.concat(F.lit("https://f/"), F.col("doc_id").cast("string"))
    made = t.select(F.col("doc_id").alias("ordinal"), F.coalesce("source", F.lit("none")).alias("ticker"), F.lit("Company").alias("company"), subject.alias("subject"), F.array(url).alias("urls"), F.lit(None).cast("timestamp_ntz").alias("event_date"))
    return made, t.select(url.alias("url"), "text")


def told(chunks: DataFrame) -> DataFrame:
    """Items of all four signals for each filing, citing its first chunk; a stand-in for a model."""
    n = F.substring_index("source_url", "/", -1).cast("long")
    item = [("statement", (n % 17 - 8) / 8.0, F.lit(""), F.lit("")), ("guidance", F.lit(0.0), F.concat(F.lit("Metric "), (n % 3).cast("string")), _pick(OUTCOME, n)),
            ("theme", (F.floor(n / 5) % 9 - 4) / 8.0, _pick(THEMES, F.floor(n / 5)), F.lit("")), ("risk", F.lit(0.0), _pick(RISKS, F.floor(n / 7)), _pick(SEVERITY, F.floor(n / 3)))]
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.cast("double").alias("tone"), name.alias("name"), v.alias("value")) for k, t, name, v in item]))
    first = chunks.where("char_start = 0").dropDuplicates(["chunk_id"])
    return first.select("ticker", "quarter", "fiscal_year", "chunk_id", F.substring("text", 1, 30).alias("quote"), n.alias("position"), said.alias("i")).select("ticker", "quarter", "fiscal_year", "chunk_id", "quote", "position", "i.*")


def two_runs(spark, d) -> tuple[SignalStore, dict[str, DataFrame]]:
    made = SignalStore(spark, shared_folder(spark, "write-path"))
    filed, texts = filings(spark, d)
    config = dataclasses.replace(DEFAULT, min_chunks_to_score=1)
    for now in RUNS:
        last = pipeline.run(spark, filed, texts, None, None, now, told, store=made, config=config)
    return made, last


#: Picked filings of the two runs (one, two), and those that the store's signals rest on in the end (kept).
PICKED = """f AS (SELECT doc_id, coalesce(source, 'none') AS ticker, [8106, 8105, 8104, 8102, 8101][doc_id // 20 % 5 + 1] AS p, text FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, p ORDER BY doc_id) AS place FROM f) WHERE place <= 15 AND length(text) >= 200),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, text ORDER BY CASE p WHEN 8105 THEN 0 WHEN 8104 THEN 1 ELSE 2 END, place) AS n FROM k WHERE p IN (8105, 8104, 8101)) WHERE n = 1),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, text ORDER BY CASE p WHEN 8106 THEN 0 WHEN 8105 THEN 1 ELSE 2 END, place) AS n FROM k WHERE p IN (8106, 8105, 8102)) WHERE n = 1),
kept AS (SELECT * FROM two UNION ALL SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM two WHERE two.ticker = one.ticker AND two.p = one.p))"""
SHIFTS = """CASE WHEN s <= -0.2::DOUBLE AND s < ps THEN 'newly_risky' WHEN prev <= 1 AND cur >= 2 THEN 'emerging' WHEN prev > 0 AND cur * 2 <= prev THEN 'fading' WHEN (prev = 0 OR cur * 2 >= prev * 3) AND s > 0 THEN 'accelerating' ELSE 'stable' END"""


def named_sql(name: str, values: tuple, by: int) -> str:
    """Counts of a quarter's named facts, each with the count of the quarter before."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"""{name} AS (SELECT a.ticker, a.p, a.name, a.cur, a.s, a.sev, a.place, coalesce(b.cur, 0) AS prev, coalesce(b.s, 0)::DOUBLE AS ps FROM {name}0 a LEFT JOIN {name}0 b ON b.ticker = a.ticker AND b.name = a.name AND b.p = a.p - 1)""", \
        f"""{name}0 AS (SELECT ticker, p, [{listed}][doc_id // {by} % {len(values)} + 1] AS name, count(*) AS cur, avg((doc_id // 5 % 9 - 4)::DOUBLE / 8) AS s, max(doc_id // 3 % 4) AS sev, min(doc_id) AS place FROM kept GROUP BY 1, 2, 3)"""


_THEME, _THEME0 = named_sql("th", THEMES, 5)
_RISK, _RISK0 = named_sql("ri", RISKS, 7)
QUARTER = "'Q' || (p % 4 + 1) AS quarter, (p // 4)::INT AS fiscal_year"


@query("l06_written_signals", f"""WITH {PICKED}, {_THEME0}, {_THEME}, {_RISK0}, {_RISK},
ths AS (SELECT *, {SHIFTS} AS status FROM th), ris AS (SELECT *, CASE WHEN prev = 0 THEN 'newly_material' WHEN cur * 2 >= prev * 3 THEN 'escalating' WHEN cur * 3 <= prev * 2 THEN 'diminishing' ELSE 'stable' END AS status FROM ri),
n AS (SELECT ticker, p, count_if(status IN ('accelerating', 'emerging')) AS up, count_if(status IN ('fading', 'newly_risky')) AS down, string_agg(name || ':' || status || ':' || cur || ':' || prev, '|' ORDER BY place) AS detail FROM ths GROUP BY 1, 2),
r AS (SELECT ticker, p, count_if(status IN ('newly_material', 'escalating')) AS up, count_if(status = 'diminishing') AS down, string_agg(name || ':' || status || ':' || ['low', 'medium', 'high', 'critical'][sev + 1] || ':' || cur || ':' || prev, '|' ORDER BY place) AS detail FROM ris GROUP BY 1, 2),
g AS (SELECT ticker, p, count_if(doc_id % 4 = 0) AS beats, count_if(doc_id % 4 = 1) AS misses, count_if(doc_id % 4 = 2) AS in_line, string_agg('Metric ' || doc_id % 3 || ':' || ['beat', 'miss', 'in_line', 'pending'][doc_id % 4 + 1], '|' ORDER BY doc_id) AS detail FROM kept GROUP BY 1, 2),
m AS (SELECT ticker, p, doc_id % 4 = 1 AND lag(doc_id % 4) OVER (PARTITION BY ticker, p ORDER BY doc_id) = 1 AS again FROM kept WHERE doc_id % 4 <> 3),
streak AS (SELECT ticker, p, coalesce(bool_or(again), FALSE) AS streak FROM m GROUP BY 1, 2)
SELECT 'confidence' AS kind, ticker, {QUARTER}, round(7 + 2 * avg((doc_id % 17 - 8)::DOUBLE / 8), 6) AS score, CASE WHEN avg((doc_id % 17 - 8)::DOUBLE / 8) >= 0.3::DOUBLE THEN 'bullish' WHEN avg((doc_id % 17 - 8)::DOUBLE / 8) <= -0.2::DOUBLE THEN 'defensive' ELSE 'mixed' END AS told, '6' AS detail FROM kept GROUP BY ticker, p
UNION ALL SELECT 'narrative', ticker, {QUARTER}, NULL, CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' WHEN up > 0 THEN 'mixed' ELSE 'neutral' END, detail FROM n
UNION ALL SELECT 'risk', ticker, {QUARTER}, NULL, CASE WHEN up > down THEN 'increasing' WHEN down > up THEN 'decreasing' ELSE 'stable' END, detail FROM r
UNION ALL SELECT 'guidance', g.ticker, 'Q' || (g.p % 4 + 1), (g.p // 4)::INT, CASE WHEN beats + misses + in_line > 0 THEN round(100::DOUBLE * ((beats + in_line * 0.8::DOUBLE + 1.5::DOUBLE) / (beats + misses + in_line + 3.0::DOUBLE)) - CASE WHEN streak THEN 10 ELSE 0 END, 6) END,
  beats || '/' || misses || '/' || in_line, detail FROM g LEFT JOIN streak ON streak.ticker = g.ticker AND streak.p = g.p""")
def _(s, d):
    """All four signals of every quarter as stored: scores before rounding, labels, and their themes, risks and guidance items."""
    made, _ = two_runs(s, d)
    key = ["ticker", "quarter", "fiscal_year"]
    raw = made.rows("signal_manifests").select(*key, "signal_type", F.round(F.get_json_object("manifest", "$.raw_total").cast("double"), 6).alias("score"))

    def of(kind, told_, detail, score=True):
        rows = made.rows(f"{kind}_signals").select(*key, told_.alias("told"), detail.alias("detail"))
        own = raw.where(F.col("signal_type") == kind).drop("signal_type") if score else None
        rows = rows.join(own, key, "left") if score else rows.withColumn("score", F.lit(None).cast("double"))
        return rows.select(F.lit(kind).alias("kind"), *key, "score", "told", "detail")

    def each(column, *fields):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|")

    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in ("beats", "misses", "in_line")])
    return (of("confidence", F.col("tone_label"), F.size("sub_dimensions").cast("string")).union(of("narrative", F.col("overall_shift"), each("themes", "theme", "status", "cur", "prev"), False))
            .union(of("risk", F.col("direction"), each("risks", "risk", "status", "severity", "cur", "prev"), False)).union(of("guidance", counts, each("guidance_items", "metric", "outcome"))))


@query("l07_marked_periods", f"""WITH {PICKED}, same AS (SELECT ticker, p, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM two GROUP BY 1, 2), before AS (SELECT ticker, p, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM one GROUP BY 1, 2),
docs_ AS (SELECT ticker, p, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT docs_.ticker, 'Q' || (docs_.p % 4 + 1) AS quarter, (docs_.p // 4)::INT AS fiscal_year, n AS documents, same.ids IS NOT NULL AND before.ids IS NOT NULL AND same.ids = before.ids AS reused
FROM docs_ LEFT JOIN same ON same.ticker = docs_.ticker AND same.p = docs_.p LEFT JOIN before ON before.ticker = docs_.ticker AND before.p = docs_.p""")
def _(s, d):
    """Every marked quarter, its documents, and whether the second run reused it."""
    made, last = two_runs(s, d)
    key = ["ticker", "quarter", "fiscal_year"]
    marks = made.rows("signal_runs").select(*key)
    filed = last["documents"].select(*key, "doc_id")
    older = made.rows("ingested_documents").select(*key, "doc_id").join(filed.select(*key).distinct(), key, "left_anti")
    n = filed.union(older).groupBy(*key).agg(F.count("*").alias("documents"))
    reused = last["reused"].select(*key, F.lit(True).alias("reused"))
    return marks.join(n, key).join(reused, key, "left").select(*key, "documents", F.coalesce("reused", F.lit(False)).alias("reused"))


@query("l07_three_period_run", f"""WITH {PICKED}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT ticker, p FROM two)) SELECT unnest(['marks', 'confidence', 'narrative', 'guidance', 'risk']) AS kind, n FROM n""")
def _(s, d):
    """One run for all companies: fetch, chunk, gate, score, store and mark; rows of each signal that the store then has."""
    made = SignalStore(s, shared_folder(s, "run-store"))
    filed, texts = filings(s, d)
    pipeline.run(s, filed, texts, None, None, RUNS[1], told, store=made, config=dataclasses.replace(DEFAULT, min_chunks_to_score=1))
    out = made.rows("signal_runs").groupBy().agg(F.lit("marks").alias("kind"), F.count("*").alias("n"))
    for k in ("confidence", "narrative", "guidance", "risk"):
        out = out.unionByName(made.rows(f"{k}_signals").groupBy().agg(F.lit(k).alias("kind"), F.count("*").alias("n")))
    return out


@query("l01_fetch_periods", f"""WITH {PICKED} SELECT substr(md5(ticker || '::investor_presentation::Q' || (p % 4 + 1) || '::' || (p // 4) || '::https://f/' || doc_id), 1, 16) AS doc_id,
'investor_presentation' AS doc_type, {QUARTER}, 'https://f/' || doc_id AS source_url, md5(substr(text, 1, 60000)) AS text_md5 FROM two""")
def _(s, d):
    """Filings of three quarters with their texts: at most fifteen a company and quarter, each text once, from all documents."""
    filed, texts = filings(s, d)
    wanted = s.createDataFrame([(p, i) for i, p in enumerate(pipeline.requested_periods(RUNS[1]))], "period_idx int, ordinal int")
    got = pipeline.fetch(filed, wanted, texts, None, None)
    return got.select("doc_id", "doc_type", "quarter", "fiscal_year", "source_url", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


SHORT = """SELECT *, row_number() OVER (PARTITION BY tk, period_idx ORDER BY CASE doc_type WHEN 'earnings_call' THEN 0 WHEN 'investor_presentation' THEN 1 WHEN 'press_release' THEN 2 WHEN 'annual_report' THEN 3 ELSE 4 END, event_date, ordinal) AS rnk
FROM (SELECT *, row_number() OVER (PARTITION BY tk, url ORDER BY ordinal) AS n FROM (SELECT *, 'T' || (ticker % 10) AS tk, coalesce(by_subject, by_date) AS period_idx FROM annp WHERE doc_type IS NOT NULL AND event_date IS NOT NULL) WHERE period_idx IS NOT NULL) WHERE n = 1"""


@query("l08_shortlist_stream", f"SELECT tk AS ticker, period_idx, rnk::INT AS rank, url, ordinal, doc_type FROM ({SHORT}) WHERE rnk <= 15")
def _(s, d):
    """The shortlist of every company and quarter, as the stream of all filings leaves it."""
    from ..streaming import shortlist

    orders = s.readStream.schema(table(s, d, "orders").schema).parquet(f"{d}/orders.parq[u]et")  # a pattern may name a file or a folder
    t = announcements_of(orders).withColumns({"ticker": F.concat(F.lit("T"), (F.col("ticker") % 10).cast("string")), "urls": F.array("url")})
    folder = shared_folder(s, "shortlist")
    shortlist.start(s, t, f"{folder}/lists", f"{folder}/checkpoint").awaitTermination()
    return shortlist.latest_lists(s.read.schema(f"{shortlist.LISTED}, batch int").parquet(f"{folder}/lists")).select("ticker", "period_idx", "rank", "url", "ordinal", "doc_type")


@query("a14_vector_collection", "SELECT ticker, count(DISTINCT chunk_id) AS n, count(DISTINCT chunk_id) * 64 AS numbers FROM (SELECT ticker, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, pos) AS k FROM lines) WHERE k = 1 GROUP BY ticker")
def _(s, d):
    """Chunks in a collection: those of calls first, then all; each is embedded once, and counted by company."""
    made, chunks = _collection(s, d)
    rows = made.rows().select("ticker", F.size("embedding").alias("k"))
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("k").alias("numbers"))


@query("j09_collection_deletes", """WITH c AS (SELECT * FROM (SELECT ticker, chunk_id, doc_id, doc_type, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, pos) AS k FROM lines) WHERE k = 1)
SELECT ticker, count(*) AS n FROM c WHERE NOT (doc_id % 3 = 0 OR ticker = 'src1') OR doc_type = 'press_release' GROUP BY ticker""")
def _(s, d):
    """The collection after its deletions by chunk and by company, and an upsert of press releases since; compacted."""
    made, chunks = _collection(s, d)
    made.delete(chunks.where("doc_id % 3 = 0").select("chunk_id"))
    made.delete_ticker("src1")
    made.upsert(chunks.where("doc_type = 'press_release'"), pipeline.embedded)
    made.compact()
    return made.rows().groupBy("ticker").agg(F.count("*").alias("n"))


def _collection(s, d):
    from ..operators.store import latest_by, settled
    from ..operators.vectors import VectorCollection

    chunks = settled(latest_by(lines(s, d), ["chunk_id"], F.col("doc_id"), F.col("pos")).withColumnRenamed("line", "text"), "collection-chunks")
    made = VectorCollection(s, shared_folder(s, "collection"))
    made.upsert(chunks.where("doc_type = 'earnings_call'"), pipeline.embedded)
    made.upsert(chunks, pipeline.embedded)
    return made, chunks
