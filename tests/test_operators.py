"""Stores, joins, chunking, retrieval, validation, the pipeline and past defects as regressions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quartermark.config import EngineConfig
from quartermark.functions import text
from quartermark.models import providers
from quartermark.operators import chunking, compare, pipeline, retrieval, store, validate
from quartermark.sources import announcements, caches, pdf
from quartermark.streaming import ingest as stream

NOW = dt.datetime(2026, 2, 1)


def signal(i, ticker, quarter, year, day, score=5.0):
    return (str(i), ticker, quarter, year, dt.datetime(2026, 1, day), score)


SIGNAL = "id string, ticker string, quarter string, fiscal_year int, generated_at timestamp_ntz, score double"


def test_upsert_replaces_and_reads_latest(spark, tmp_path):
    s = store.SignalStore(spark, str(tmp_path))
    s.upsert("confidence_signals", spark.createDataFrame([signal(1, "A", "Q1", 2026, 1), signal(2, "B", "Q1", 2026, 1)], SIGNAL))
    s.upsert("confidence_signals", spark.createDataFrame([signal(3, "A", "Q1", 2026, 2, 6.0)], SIGNAL))
    rows = {r["ticker"]: r["score"] for r in s.rows("confidence_signals").collect()}
    assert rows == {"A": 6.0, "B": 5.0}
    s.delete_ticker("A")
    assert [r["ticker"] for r in s.rows("confidence_signals").collect()] == ["B"]
    assert s.wipe() and s.rows("confidence_signals").count() == 1
    s.wipe(really=True)
    assert s.rows("confidence_signals").count() == 0


def test_documents_are_capped_once(spark, tmp_path):
    s = store.SignalStore(spark, str(tmp_path), EngineConfig(doc_max_chars=10))
    s.upsert("ingested_documents", spark.createDataFrame([("d", "A", "Q1", 2026, "x" * 50)], "doc_id string, ticker string, quarter string, fiscal_year int, raw_text string"))
    assert s.rows("ingested_documents").select(F.length("raw_text")).first()[0] == 10
    assert s.documents("A", quarter="Q1").count() == 1 and s.documents("A", quarter="Q1", fiscal_year=2025).count() == 0


def test_prune_with_an_empty_keep_set_deletes_nothing(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert store.prune(stored, stored.limit(0)).count() == 2
    assert store.prune(stored, stored.where("doc_id = 'a'")).count() == 1


def test_fingerprint_changes_with_its_inputs_only(spark):
    d = spark.createDataFrame([("T", "Q1", 2026, "a", 3), ("T", "Q1", 2026, "b", 2)], "ticker string, quarter string, fiscal_year int, doc_id string, n_chunks int")

    def fp(df, **k):
        return store.corpus_fingerprint(df, **{"model": "m", "version": "v", "profile": "p", **k}).first()["fingerprint"]

    base = fp(d)
    assert base == fp(d.orderBy(F.desc("doc_id")).withColumn("ingested_at", F.current_timestamp()))
    assert len({base, fp(d, model="n"), fp(d, version="w"), fp(d, profile="q"), fp(d.limit(1)), fp(d.withColumn("n_chunks", F.lit(9)))}) == 6


def test_delta_is_null_across_a_gap(spark):
    t = spark.createDataFrame([("T", 1, 5.0), ("T", 2, 6.0), ("T", 4, 9.0)], "ticker string, period_idx int, score double")
    got = {r["period_idx"]: r["score_delta"] for r in compare.gap_safe_delta(t, "score").collect()}
    assert got == {1: None, 2: 1.0, 4: None}


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "a", "b", "ab ab", "d,"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(99, None)]
    quotes = [(i, docs[rng.randrange(60)][1][rng.randint(0, 9): rng.randint(5, 40)]) for i in range(80)] + [(98, None), (97, ""), (96, "b  b")]
    got = compare.contained(spark.createDataFrame(quotes, "q int, text string"), "text", spark.createDataFrame(docs, "d int, text string"), "text", "q", "d")
    want = {(q, d) for q, x in quotes for d, t in docs if x and t and x in t}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("name, prior, matched", [
    ("Deposit competition", "deposit  competition", True), ("deposit competition", "deposit competitions", True),
    ("asset quality / npas", "asset quality (npas)", True), ("nim compression", "margin compression", False),
])
def test_fuzzy_prior(spark, name, prior, matched):
    cur = spark.createDataFrame([("T", 5, name)], "ticker string, period_idx int, name string")
    old = spark.createDataFrame([("T", 5, "other", 0), ("T", 5, prior, 1)], "ticker string, period_idx int, name string, pos int")
    got = compare.match_prior(cur, old, "name", ["ticker", "period_idx"], "pos").first()["matched"]
    assert got == (prior if matched else None)


TABLE = "| Item | Q1 |\n|---|---|\n" + "\n".join(f"| Row number {i} | {i * 100} |" for i in range(5))


def test_chunker_keeps_tables_whole_and_prose_packed():
    raw = "Opening words before anyone speaks, long enough to be kept as a chunk.\nJohn Smith: As CEO I am glad. " + "Sales grew well this year. " * 40 + "\n# Financial results\n" + TABLE + "\n"
    got = list(chunking.chunks_of("d", "Title", raw))
    tables = [c for c in got if c[4].startswith("|")]
    assert len(tables) == 1 and tables[0][4] == TABLE and tables[0][3] is True and tables[0][6] == "Title — Financial results" and tables[0][1] == "financial_results"
    assert got[0][2] == "" and "Opening words" in got[0][4]
    spoken = [c for c in got if c[2] == "John Smith"]
    assert spoken and all(c[3] for c in spoken) and all(len(c[4]) <= 512 + 64 + 30 for c in spoken)
    assert len({c[0] for c in got}) == len(got)
    assert [c[5] for c in got] == [sum(len(x[4]) for x in got[:i]) for i in range(len(got))]


def test_chunk_length_gate_and_long_sentences():
    assert [len(list(chunking.chunks_of("d", "", "x" * n))) for n in (50, 51)] == [0, 1]
    assert len(chunking.pack_sentences("y" * 700 + ". " + "z" * 60 + ".", 512, 64, 50)) == 2


def test_oversized_table_repeats_its_header():
    table = "| Item | Q1 |\n|---|---|\n" + "\n".join(f"| {'row ' * 20}{i} | {i} |" for i in range(100))
    parts = chunking.table_parts(table, 6000)
    assert len(parts) > 1 and all(p.startswith("| Item | Q1 |\n|---|---|\n") for p in parts)
    assert [r for p in parts for r in p.split("\n")[2:]] == table.split("\n")[2:]


def test_retrieval_ties_and_filters(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert [r["chunk_id"] for r in retrieval.top_k(q, c, 2).orderBy("rank").collect()] == ["a", "b"]
    rows = spark.createDataFrame([("Q1", 2025), ("Q1", 2026), ("Q2", 2026)], "quarter string, fiscal_year int")
    assert retrieval.metadata_filter(rows, periods=[("Q1", 2026)]).count() == 1


def test_rerank_modes(spark):
    c = spark.createDataFrame([("a", "margins rose", 0.1), ("b", "nothing here", 0.9)], "chunk_id string, text string, score double")
    q = spark.createDataFrame([(1, "margins rose")], "query_id int, query string")
    assert retrieval.rerank(c, q).first().asDict() == {"chunk_id": "b", "relevance": 0.9, "mode": "vector_order"}
    best = retrieval.rerank(c, q, scorer=retrieval.lexical_overlap).orderBy(F.desc("relevance")).first()
    assert (best["chunk_id"], best["mode"]) == ("a", "reranked")


def test_verdicts(spark):
    def verdict(*statuses):
        from quartermark.operators.aggregates import verdict as of

        return of(spark.createDataFrame([(x,) for x in statuses], "status string")).first()["verdict"]

    assert verdict("PASS", "PASS", "SKIP") == "INCONCLUSIVE"
    assert verdict("PASS", "PASS", "PASS") == "DEFENSIBLE"
    assert verdict("PASS", "WARN", "PASS") == "WARN"
    assert verdict("FAIL", "PASS") == "NOT TRUSTWORTHY"
    assert [validate.exit_code(x) for x in ("DEFENSIBLE", "WARN", "NOT TRUSTWORTHY", "INCONCLUSIVE")] == [0, 0, 1, 2]


def filings(spark):
    rows = [
        (1, "Results for the quarter ended December 31, 2025", "u1", NOW), (2, "Transcript of earnings call", "u2", dt.datetime(2026, 2, 10)),
        (3, "Results for the quarter ended December 31, 2025", "u1", NOW), (4, "Closure of trading window", "u4", NOW), (5, "Press release", "u5", None),
        (6, "Press release quarter ended 30th September, 2025", "u6", NOW), (7, "Investor presentation Q3 FY26", "u7", NOW),
    ]
    return spark.createDataFrame(rows, "ordinal int, subject string, url string, event_date timestamp_ntz").withColumn("urls", F.array("url")).drop("url")


def test_candidates_date_classify_and_dedupe(spark):
    wanted = spark.createDataFrame([(8106,), (8105,)], "period_idx int")
    got = {(r["ordinal"], r["period_idx"], r["doc_type"], r["rank"]) for r in announcements.candidates(filings(spark), wanted).collect()}
    assert got == {(2, 8106, "earnings_call", 1), (7, 8106, "investor_presentation", 2), (1, 8106, "press_release", 3), (6, 8105, "press_release", 1)}


def test_at_most_fifteen_documents_a_period(spark):
    rows = [(i, "Press release quarter ended June 30, 2025", [f"u{i}"], dt.datetime(2025, 7, 1 + i)) for i in range(16)]
    a = spark.createDataFrame(rows, "ordinal int, subject string, urls array<string>, event_date timestamp_ntz")
    wanted = spark.createDataFrame([(8104,)], "period_idx int")
    assert {r["ordinal"] for r in announcements.candidates(a, wanted).collect()} == set(range(15))
    assert {r["ordinal"] for r in announcements.candidates(a, wanted, recency="newest").collect()} == set(range(1, 16))


def body(n, word):
    return (f"{word} revenue was strong in the quarter and demand held up well. " * 60)[:n]


def test_run_end_to_end(spark):
    texts = spark.createDataFrame([("u1", body(3000, "Alpha")), ("u2", body(3000, "Alpha")), ("u6", body(3000, "Beta")), ("u7", "too short")], "url string, text string")

    def extract(chunks):
        return chunks.select("ticker", "quarter", "fiscal_year", "chunk_id", F.lit("statement").alias("kind"), F.when(F.col("char_start") == 0, F.substring("text", 1, 30)).otherwise("not there").alias("quote"), F.lit(0.5).alias("tone"))

    out = pipeline.run(spark, filings(spark), texts, "TCK", "Company", NOW, extract)
    docs = {(r["source_url"], r["quarter"], r["fiscal_year"]) for r in out["documents"].collect()}
    assert docs == {("u2", "Q3", 2026), ("u6", "Q2", 2026)}  # the same text twice counts once, the better type wins
    scored = {r["quarter"]: r["score"] for r in out["confidence"].collect()}
    assert scored == {"Q3": 8.0, "Q2": 8.0} and out["dropped"].count() > 0


def every_kind(chunks):
    """Items of all four signals from the first chunk of each document, and one quote that stands nowhere."""
    first = chunks.where("char_start = 0").dropDuplicates(["chunk_id"])
    said = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(k).alias("kind"), F.lit(t).alias("tone"), F.lit(n).alias("name"), F.lit(v).alias("value")) for p, (k, t, n, v) in enumerate([
        ("statement", 0.5, "", ""), ("guidance", 0.0, "Margin", "beat"), ("guidance", 0.0, "Volume", "miss"), ("theme", 0.4, "demand", ""), ("theme", 0.2, "demand", ""), ("risk", 0.0, "fuel", "low"), ("risk", 0.0, "fuel", "high"), ("theme", 0.0, "absent", "")])]))
    rows = first.select(*PERIOD_KEYS, "chunk_id", F.substring("text", 1, 30).alias("start"), said.alias("i")).select(*PERIOD_KEYS, "chunk_id", "start", "i.*")
    return rows.select(*PERIOD_KEYS, "chunk_id", "kind", F.when(F.col("name") == "absent", "not there at all").otherwise(F.col("start")).alias("quote"), "tone", "position", "name", "value")


PERIOD_KEYS = ["ticker", "quarter", "fiscal_year"]


def test_four_signals_are_scored_stored_and_gated(spark, tmp_path):
    from quartermark.operators.store import SignalStore

    texts = spark.createDataFrame([("u2", body(3000, "Alpha")), ("u6", body(3000, "Beta"))], "url string, text string")
    made = SignalStore(spark, str(tmp_path / "store"))
    queries = spark.createDataFrame([(k, "Alpha grows") for k in ("confidence", "narrative", "guidance", "risk")], "kind string, query string")
    out = pipeline.run(spark, filings(spark), texts, "TCK", "Company", NOW, every_kind, store=made, queries=queries)
    assert {r["kind"] for r in out["dropped"].collect()} == {"theme"} and out["marks"].count() == 2
    for kind in ("confidence", "narrative", "guidance", "risk"):
        rows = made.rows(f"{kind}_signals").collect()
        assert {(r["id"], r["quarter"]) for r in rows} == {(f"{kind}::TCK::Q3::2026", "Q3"), (f"{kind}::TCK::Q2::2026", "Q2")}
    g = made.rows("guidance_signals").first()
    assert (g["beats"], g["misses"], g["score"]) == (1, 1, 50.0)
    assert {r["direction"] for r in made.rows("risk_signals").collect()} <= {"increasing", "stable", "decreasing"}
    assert made.rows("signal_manifests").count() == 4 and made.rows("ingested_documents").count() == 2
    asked = []
    again = pipeline.run(spark, filings(spark), texts, "TCK", "Company", NOW, lambda c: asked.append(c.count()) or every_kind(c), store=made)
    assert asked == [0] and again["reused"].count() == 2 and again["marks"].count() == 0  # nothing changed, nothing is scored
    later = pipeline.run(spark, filings(spark), texts, "TCK", "Company", NOW, every_kind, store=made, version="2")
    assert later["reused"].count() == 0 and later["marks"].count() == 2 and made.rows("signal_runs").count() == 2


def test_companies_are_fetched_at_once_each_by_itself(spark):
    texts = spark.createDataFrame([("u2", body(3000, "Alpha")), ("u6", body(3000, "Beta"))], "url string, text string")
    wanted = spark.createDataFrame([(8106, 0), (8105, 1), (8102, 2)], "period_idx int, ordinal int")
    one = filings(spark)
    both = one.withColumns({"ticker": F.lit("A"), "company": F.lit("Ax")}).union(one.withColumns({"ticker": F.lit("B"), "company": F.lit("Bx")}))
    got = {(r["ticker"], r["source_url"]) for r in pipeline.fetch(both, wanted, texts, None, None).collect()}
    alone = {r["source_url"] for r in pipeline.fetch(one, wanted, texts, "T", "C").collect()}
    assert got == {(t, u) for t in ("A", "B") for u in alone} and alone


@pytest.mark.parametrize("most", [200_000, 3])
def test_texts_of_filings_that_are_not_picked_are_not_shuffled(spark, monkeypatch, most):
    """Addresses go to the texts while they are few enough; beyond that the join gives the same rows."""
    monkeypatch.setattr(pipeline, "MOST_PICKED", most)
    filed = spark.range(400).select(F.col("id").alias("ordinal"), F.concat(F.lit("T"), (F.col("id") % 2).cast("string")).alias("ticker"), F.lit("C").alias("company"), F.lit("Investor Presentation Q3 FY26").alias("subject"),
                                    F.array(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("urls"), F.lit(None).cast("timestamp_ntz").alias("event_date"))
    texts = spark.range(0, 400, 1, 4).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 100)).alias("text"))
    wanted = spark.createDataFrame([(8106, 0)], "period_idx int, ordinal int")
    docs = pipeline.fetch(filed, wanted, texts, None, None)
    assert sorted(r["source_url"] for r in docs.collect()) == sorted(f"u{i}" for i in range(30))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan and "strategy=broadcast" in plan[plan.index("LeftSemi"):]) == (most > 3)



def test_short_quotes_are_found_without_comparing_all_texts(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a catalogue of things"), (3, None), (4, "x  y"), (1, "the cat sat")], "doc_id long, text string")
    quotes = [(1, "cat"), (2, "cat sat"), (3, "talogue"), (4, "catalogue of"), (5, " "), (6, "the cat sat on"), (7, "zz"), (8, "t s"), (9, ""), (10, "e cat s"), (11, "extraordinarily")]
    df = compare.contained(spark.createDataFrame(quotes, "q long, quote string"), "quote", docs, "text", "q", "doc_id")
    want = {(q, d) for q, t in quotes if t for d, x in [(1, "the cat sat"), (2, "a catalogue of things"), (4, "x  y")] if t in x}
    assert {tuple(r) for r in df.collect()} == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_top_k_against_brute_force(spark, monkeypatch):
    import numpy as np

    from quartermark.operators import retrieval

    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 6)).astype(np.float32)
    x[7], x[8] = x[3], 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None)]
    e = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    q = e.where("chunk_id % 20 = 0 and chunk_id < 200").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-300)[:, None]
    for tile, step in ((2048, 512), (7, 3)):
        monkeypatch.setattr(retrieval, "TILE", tile)
        monkeypatch.setattr(retrieval, "QUERY_STEP", step)
        monkeypatch.setattr(retrieval, "CHUNK_TILES", 2)
        got = retrieval.top_k(q, e, 5).collect()
        for i in range(0, 120, 20):
            score = u @ u[i]
            score[8] = -np.inf
            want = sorted(range(120), key=lambda j: (-round(score[j], 12), j))[:5]
            mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
            assert [r["chunk_id"] for r in mine] == want and np.allclose([r["score"] for r in mine], score[want])


def test_top_k_of_repeats_odd_vectors_and_names(spark, monkeypatch):
    from quartermark.operators import retrieval

    monkeypatch.setattr(retrieval, "TILE", 3)
    monkeypatch.setattr(retrieval, "CHUNK_TILES", 1)
    rows = [(f"c{i:02d}", [1.0, 0.0]) for i in range(9)] + [("z", [0.0, 0.0]), ("y", None), ("x", [1.0, 2.0, 3.0]), (None, [0.6, 0.8]), ("w", [float("nan"), 1.0])]
    e = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(2)
    q = spark.createDataFrame([("same", [2.0, 0.0]), ("none", [0.0, 0.0]), ("wide", [1.0, 2.0, 3.0])], "query_id string, query_vector array<double>")
    got = {n: [(r["chunk_id"], r["score"] and round(r["score"], 9)) for r in sorted((x for x in retrieval.top_k(q, e, 12).collect() if x["query_id"] == n), key=lambda r: r["rank"])] for n in ("same", "none", "wide")}
    assert got["same"] == [(f"c{i:02d}", 1.0) for i in range(9)] + [(None, 0.6), ("w", None), ("x", None)]
    assert got["none"][:3] == [(None, None), ("c00", None), ("c01", None)] and len(got["none"]) == 12
    assert got["wide"][0] == ("x", 1.0) and got["wide"][1] == (None, None)
    assert retrieval.top_k(q, e.limit(0), 3).count() == 0 and retrieval.top_k(q.limit(0), e, 3).count() == 0


def test_top_k_shuffles_no_vector(spark):
    from quartermark.operators import retrieval

    e = spark.range(50).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    plan = retrieval.top_k(e.toDF("query_id", "query_vector"), e, 3)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and "Cartesian" not in plan and "NestedLoop" not in plan
    assert all("vectors" not in line and "embedding" not in line for line in exchanges)


def test_reliability_by_spread_and_guidance_ledger(spark):
    from quartermark.operators import scoring

    df = spark.createDataFrame([(5, 0.2), (5, 0.25), (5, 0.4), (5, 0.6), (0, None), (2, None), (5, None)], "n int, spread double")
    assert [r[0] for r in df.select(scoring.reliability(F.col("n"), None, F.col("spread"))).collect()] == ["high", "high", "medium", "low", "low", "medium", "high"]
    m = scoring.manifest(scoring.guidance_baseline(F.lit(2), F.lit(1), F.lit(4)), scoring.guidance_ledger(F.lit(True), F.lit(False), F.lit(True)), 0.0, 100.0)
    r = spark.range(1).select(m.alias("m")).first()["m"]
    assert [(i["label"], i["delta"]) for i in r["items"]] == [("track_record", 0.0), ("serial_miss_risk", -10.0), ("withdrew_guidance", -8.0)]
    assert abs(r["total"] - (100 * 4.3 / 7 - 18)) < 1e-9


def test_unchanged_rerun_still_passes_the_gate(spark):
    texts = spark.createDataFrame([("u6", body(3000, "Beta"))], "url string, text string")
    wanted = spark.createDataFrame([(8105, 0)], "period_idx int, ordinal int")
    docs = pipeline.fetch(filings(spark), wanted, texts, "T", "C")
    chunks, counts = pipeline.ingest(docs, chunking.chunk_documents(docs.limit(0)))
    again, recount = pipeline.ingest(docs, chunks)
    assert counts.first()["n_chunks"] == recount.first()["n_chunks"] >= 5 and again.count() == chunks.count()


def test_requested_periods():
    assert pipeline.requested_periods(dt.datetime(2026, 2, 1)) == [8106, 8105, 8102]
    assert pipeline.requested_periods(NOW, 1, 2026) == [8104, 8103, 8100]


def test_paged_sources(spark, tmp_path):
    for page, names in ((1, ["a", "b"]), (2, ["c"])):
        rows = [{"HEADLINE": n, "NEWSSUB": "x", "ATTACHMENTNAME": f"{n}.pdf", "NEWS_DT": "bad", "DT_TM": "2026-01-02T10:00:00", "TotalPageCnt": 3} for n in names]
        (tmp_path / f"page{page}.json").write_text(json.dumps({"Table": rows}))
    announcements.register(spark)
    got = announcements.bse_rows(spark.read.format("bse_announcements").option("path", str(tmp_path)).load()).collect()
    assert {r["subject"] for r in got} == {"a x", "b x", "c x"} and all(len(r["urls"]) == 2 and r["event_date"] == dt.datetime(2026, 1, 2, 10) for r in got)
    (tmp_path / "page1.json").write_text(json.dumps([{"desc": "d", "attchmntText": "t", "attchmntFile": "f", "an_dt": "31-Jan-2026 10:00:00"}]))
    got = announcements.nse_rows(spark.read.format("nse_announcements").option("path", str(tmp_path)).load()).first()
    assert got["subject"] == "d t" and got["event_date"] == dt.datetime(2026, 1, 31, 10)


def test_cache_needs_version_and_limit(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    parsed = urls.withColumn("text", F.lit("t"))
    cache = caches.entries(parsed.where("url = 'a'"), "v2", 25).union(caches.entries(parsed.where("url = 'b'"), "v1", 25))
    hits, misses = caches.split_hits(urls, cache, "v2", 25)
    assert [r["url"] for r in hits.collect()] == ["a"] and {r["url"] for r in misses.collect()} == {"b", "c"}
    assert caches.stats(cache).first().asDict() == {"entries": 2, "bytes": 2}


def test_extraction_cascade_never_raises(spark):
    def broken(data):
        raise ValueError("no")

    df = spark.createDataFrame([(bytearray(b"hello"),), (None,)], "c binary")
    got = [tuple(r["r"]) for r in df.select(pdf.extract(F.col("c"), (("broken", broken), ("plain", pdf.plain_bytes))).alias("r")).collect()]
    assert got == [("hello", "plain"), ("", "failed")]


def test_completer_retries_and_reports(spark):
    def always_fails(system, user):
        raise RuntimeError("down")

    p = spark.createDataFrame([("1", "s", "may best")], "id string, system string, user string")
    got = providers.complete(p, always_fails, attempts=2, wait=0.0).first()
    assert (got["ok"], got["attempts"], got["error"]) == (False, 2, "RuntimeError: down")
    assert json.loads(providers.complete(p).first()["payload"]) == {"hedging_markers": 1, "superlative_terms": 1, "words": 2}


def test_narration_cache_and_fallback(spark):
    facts = spark.createDataFrame([("1", "h", ["d"], "plain")], "id string, headline string, drivers array<string>, fallback string")
    empty = spark.createDataFrame([], "fingerprint string, prose string")
    first = providers.narrate(facts, empty).first()
    assert (first["prose"], first["cached"]) == ("plain", False)
    cached = spark.createDataFrame([(first["fingerprint"], "told")], "fingerprint string, prose string")
    assert providers.narrate(facts, cached).first()["prose"] == "told"
    assert json.loads(providers.narrate(facts, empty, providers.rule_completer).first()["prose"])["words"] == 2


def test_longest_price_prefix_wins(spark):
    calls = spark.createDataFrame([("gpt-4o-mini-2024",), ("gpt-4o",), ("else",)], "model string")
    prices = spark.createDataFrame([(m, *p) for m, p in providers.PRICES.items()], "model string, price_in double, price_out double")
    assert {r["model"]: r["price_in"] for r in providers.price_join(calls, prices).collect()} == {"gpt-4o-mini-2024": 0.15, "gpt-4o": 2.5, "else": None}


def test_stream_takes_each_url_once(spark, tmp_path):
    source = tmp_path / "in"
    filings(spark).select("subject", "urls", "event_date").write.parquet(str(source))
    rows = spark.readStream.schema("subject string, urls array<string>, event_date timestamp_ntz").parquet(str(source))
    seen = []
    stream.start(spark, rows, lambda batch, i: seen.extend(r["url"] for r in batch.select("url").collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["u1", "u2", "u6", "u7"]


def test_hashed_embedding_has_length_one(spark):
    v = spark.createDataFrame([("alpha beta",), ("",)], "t string").select(providers.hashed_embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-6 and not any(v[1]["v"])


def test_quote_checks(spark):
    corpus = spark.createDataFrame([(1, "demand was strong in the rural markets this quarter")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "was strong in the rural mar"), (2, "was weak in the rural markets"), (3, "short")], "quote_id int, text string")
    assert [r["quote_id"] for r in validate.unverified_quotes(quotes, corpus).collect()] == [2]


def test_ids_and_keys(spark):
    row = spark.createDataFrame([("T", None)], "t string, q string").select(text.natural_key("conf", F.col("t"), F.col("q"), F.lit(2026)).alias("k")).first()
    assert row["k"] == "conf::T::unknown::2026"


def test_few_pairs_of_names_go_to_python_and_none_is_lost(spark):
    import difflib

    rng = random.Random(9)
    words = ["deposit", "deposits", "competition", "competitive", "margin", "margins", "pressure", "rural", "demand", "café", "日本", "fx", ""]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").distinct()
    rows = pairs.select("a", "b", compare.could_reach(F.col("a"), F.col("b"), 0.85).alias("ok")).collect()
    near = {(r["a"], r["b"]) for r in rows if difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() >= 0.85}
    sent = {(r["a"], r["b"]) for r in rows if r["ok"]}
    assert near <= sent and len(sent) < 0.25 * len(rows)
    cur = spark.createDataFrame([(1, n, i) for i, n in enumerate(dict.fromkeys(names))], "k int, name string, position int")
    got = {r["name"]: r["matched"] for r in compare.match_prior(cur, cur.withColumn("name", F.concat("name", F.lit("s"))), "name", ("k",), "position").collect()}
    olds = [(n + "s", i) for i, n in enumerate(dict.fromkeys(names))]
    for n in got:
        scores = [(2.0 if text_of(o) == text_of(n) else difflib.SequenceMatcher(None, text_of(n), text_of(o)).ratio(), -i, o) for o, i in olds]
        best = max(scores)
        assert got[n] == (best[2] if best[0] >= 0.85 else None)


def text_of(name):
    return " ".join(name.lower().split())
