"""Runs into a store: baselines of reused quarters, whole rows, commits, compaction, older schemas."""

import dataclasses
import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from quartermark import schemas
from quartermark.api import SignalApi
from quartermark.config import DEFAULT
from quartermark.models.prompts import Spec
from quartermark.operators import pipeline
from quartermark.operators.store import SignalStore

CONFIG = dataclasses.replace(DEFAULT, min_chunks_to_score=1)
SUBJECT = {8104: "Investor Presentation Q1 FY26", 8105: "Investor Presentation Q2 FY26", 8106: "Investor Presentation Q3 FY26", 8102: "Investor Presentation Q3 FY25"}
NOW = dt.datetime(2026, 2, 1)
KEY = "id string, ticker string, quarter string, fiscal_year int, generated_at timestamp_ntz"


def filings(spark, said):
    """A filing a quarter; its text holds a line for each item: kind|name|value|tone, and words."""
    rows = [(i, SUBJECT[p], [f"u{p}"], None) for i, p in enumerate(sorted(said))]
    texts = [(f"u{p}", "\n".join(f"{line} is what was said in the call of the quarter." for line in lines) + "\n" + "other words follow here. " * 20) for p, lines in said.items()]
    return spark.createDataFrame(rows, "ordinal int, subject string, urls array<string>, event_date timestamp_ntz"), spark.createDataFrame(texts, "url string, text string")


def told(chunks):
    line = F.explode(F.regexp_extract_all("text", F.lit(r"(\w+\|[^|\n]*\|[^|\n]*\|[-0-9.]+ is what was said in the call)"), F.lit(1)))
    part = F.split("quote", r"\|")
    rows = chunks.select("ticker", "quarter", "fiscal_year", "chunk_id", "text", line.alias("quote")).withColumn("position", F.expr("locate(quote, text)"))
    return rows.select("ticker", "quarter", "fiscal_year", "chunk_id", "quote", "position", part[0].alias("kind"), part[1].alias("name"), part[2].alias("value"), F.split(part[3], " ")[0].cast("double").alias("tone")).dropDuplicates(["ticker", "quarter", "fiscal_year", "kind", "quote"])


def run(spark, store, said, **kw):
    filed, texts = filings(spark, said)
    return pipeline.run(spark, filed, texts, "TCK", "Company", NOW, told, store=store, config=CONFIG, **kw)


TALK = ["statement|||0.5"]
SAID = {
    8102: [*TALK, "theme|demand||0.2", "risk|fuel|low|0", "guidance|Margin|beat|0"],
    8105: [*TALK, "theme|demand||0.2", "theme|demand||0.3", "risk|fuel|low|0", "guidance|Margin|beat|0", "guidance|Volume|miss|0"],
    8106: [*TALK, "theme|demand||0.2", "theme|demand||0.4", "theme|demand||0.6", "theme|exports||0.1", "theme|exports||0.2", "risk|fuel|high|0", "risk|strikes|critical|0", "guidance|Margin|miss|0"],
}
SHIFT = ["overall_shift", "themes", "accelerating", "emerging", "fading", "newly_risky", "summary", "prior_available"]


def shifts(store):
    n = {(r["quarter"], r["fiscal_year"]): tuple(r[c] for c in SHIFT) for r in store.rows("narrative_signals").collect()}
    r = {(r["quarter"], r["fiscal_year"]): (r["direction"], r["risks"], r["new_risks"], r["escalating"], r["diminishing"], r["summary"]) for r in store.rows("risk_signals").collect()}
    return n, r


def test_a_partial_rerun_gives_what_a_whole_run_gives(spark, tmp_path):
    whole = SignalStore(spark, str(tmp_path / "whole"))
    run(spark, whole, SAID)
    n, r = shifts(whole)
    themes = {t["theme"]: (t["status"], t["cur"], t["prev"], t["count_change"]) for t in n["Q3", 2026][1]}
    assert themes == {"demand": ("accelerating", 3, 2, 1), "exports": ("emerging", 2, 0, 2)} and n["Q3", 2026][-1] and not n["Q2", 2026][-1]
    assert {x["risk"]: (x["status"], x["severity"]) for x in r["Q3", 2026][1]} == {"fuel": ("stable", "high"), "strikes": ("newly_material", "critical")}
    # the later quarter first has another text; then only it is scored anew
    parts = SignalStore(spark, str(tmp_path / "parts"))
    run(spark, parts, SAID | {8106: [*TALK, "theme|demand||0.1", "risk|fuel|low|0", "guidance|Margin|miss|0"]})
    again = run(spark, parts, SAID)
    assert again["reused"].count() == 2 and shifts(parts) == (n, r)
    # the earlier quarter changes: the later one, though reused, gets its new baseline
    changed = SAID | {8105: [*TALK, *["note|||0"] * 25, "theme|exports||0.3", "theme|exports||0.3", "risk|strikes|low|0", "guidance|Margin|beat|0"]}
    late = run(spark, parts, changed)
    assert {x["quarter"] for x in late["marks"].collect()} == {"Q2"}
    fresh = SignalStore(spark, str(tmp_path / "fresh"))
    run(spark, fresh, changed)
    assert shifts(parts) == shifts(fresh) != (n, r)
    assert parts.rows("narrative_signals").where("quarter = 'Q3' and fiscal_year = 2026").first()["citations"]


def test_stored_rows_are_whole(spark, tmp_path):
    store = SignalStore(spark, str(tmp_path))
    run(spark, store, SAID)
    q3 = "quarter = 'Q3' and fiscal_year = 2026"
    for kind in schemas.SIGNALS:
        rows = store.rows(f"{kind}_signals").where(q3).collect()
        assert len(rows) == 1 and rows[0]["company"] == "Company" and rows[0]["citations"] and rows[0]["summary"]
        assert [c["quarter"] for c in rows[0]["citations"]] == ["Q3 2026"] * len(rows[0]["citations"])
    c = store.rows("confidence_signals").where(q3).first()
    assert len(c["sub_dimensions"]) == 6 and c["drivers"] == ["tone"] and c["previous_score"] is None
    g = store.rows("guidance_signals").where("quarter = 'Q2'").first()
    assert [(i["metric"], i["outcome"]) for i in g["guidance_items"]] == [("Margin", "beat"), ("Volume", "miss")] and (g["tracked"], g["beat_rate"], g["reliability"]) == (2, 0.5, "medium")
    quotes = store.rows("narrative_signals").where(q3).first()["themes"][0]["key_quotes"]
    assert len(quotes) == 2 and all(q.startswith("theme|demand") for q in quotes)
    y = SignalApi(store).ytd_risks("TCK").where("fiscal_year = 2026").first()
    assert (y["new"], y["active"]) == (["fuel", "strikes"], ["fuel", "strikes"])
    panel = SignalApi(store).evidence("narrative", "TCK", "Q3", 2026).first()
    assert panel["quotes"] and panel["citations"]


def test_retrieval_filters_degraded_marks_and_narration(spark, tmp_path):
    specs = {"confidence": Spec(("what was said",), 6), "narrative": Spec(("demand exports",), 5, doc_types=("investor_presentation",)), "guidance": Spec(("margin volume",), 6, many_periods=True), "risk": Spec(("fuel strikes",), 5, sections=("nowhere",))}
    store = SignalStore(spark, str(tmp_path / "a"))
    out = run(spark, store, SAID, queries=specs)
    kinds = {(r["kind"], r["quarter"], r["fiscal_year"], r["chunk_quarter"], r["mode"]) for r in out["evidence"].collect()}
    assert {k for k, *_ in kinds} == {"confidence", "narrative", "guidance"} and {m for *_, m in kinds} == {"vector_order"}  # no chunk of the risk's section
    assert {c for k, q, y, c, _ in kinds if (k, q, y) == ("guidance", "Q3", 2026)} == {"Q1", "Q2", "Q3"} - {"Q1"}
    assert {(q, c) for k, q, _, c, _ in kinds if k == "narrative"} == {("Q3", "Q3"), ("Q2", "Q2")}

    def broken(queries, texts):
        raise RuntimeError("no model")

    specs["risk"] = Spec(("fuel strikes",), 5)
    other = SignalStore(spark, str(tmp_path / "b"))
    out = run(spark, other, SAID, queries=specs, scorer=broken)
    assert {r["mode"] for r in out["evidence"].collect()} == {"vector_order_degraded"} and out["marks"].count() == 0
    assert other.rows("confidence_signals").count() == 3  # kept, but not marked

    from quartermark.operators.retrieval import lexical_overlap

    out = run(spark, other, SAID, queries=specs, scorer=lexical_overlap, narrator=lambda system, user: f"told: {user.splitlines()[0]}")
    assert {r["mode"] for r in out["evidence"].collect()} == {"reranked"} and out["marks"].count() == 3
    assert {r["summary"] for r in other.rows("risk_signals").collect()} == {"told: risk"} and out["prose"].count() > 0


def rows(spark, ticker, day, score=5.0, quarter="Q1"):
    return spark.createDataFrame([(f"{ticker}{quarter}", ticker, quarter, 2026, dt.datetime(2026, 1, day), score)], f"{KEY}, score double")


def test_a_commit_of_several_tables_shows_whole_or_not_at_all(spark, tmp_path):
    store = SignalStore(spark, str(tmp_path))
    bad = rows(spark, "A", 2).withColumn("score", F.raise_error(F.lit("fails while it is written")).cast("double"))
    with pytest.raises(Exception, match="fails while"):
        store.commit({"confidence_signals": rows(spark, "A", 1), "guidance_signals": bad})
    assert store.rows("confidence_signals").count() == store.rows("guidance_signals").count() == 0
    store.commit({"confidence_signals": rows(spark, "A", 1), "guidance_signals": rows(spark, "A", 1)})
    assert SignalStore(spark, str(tmp_path)).rows("guidance_signals").count() == 1


def test_writers_at_once_lose_nothing(spark, tmp_path):
    errors = []

    def write(name):
        try:
            store = SignalStore(spark, str(tmp_path))
            for day in range(1, 5):
                store.upsert("confidence_signals", rows(spark, name, day, float(day)))
            if name == "B":
                store.delete_ticker("Z")
        except Exception as e:  # told below
            errors.append(e)

    SignalStore(spark, str(tmp_path)).upsert("confidence_signals", rows(spark, "Z", 1))
    threads = [threading.Thread(target=write, args=(n,)) for n in "ABC"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = SignalStore(spark, str(tmp_path))
    assert not errors and len(store.commits.entries()) == 14
    assert {(r["ticker"], r["score"]) for r in store.rows("confidence_signals").collect()} == {("A", 4.0), ("B", 4.0), ("C", 4.0)}
    assert store.log("confidence_signals").count() == 12


def test_deletion_hides_what_came_before_and_compaction_keeps_that(spark, tmp_path):
    a, b = SignalStore(spark, str(tmp_path)), SignalStore(spark, str(tmp_path))
    for day in (1, 2):
        a.upsert("confidence_signals", rows(spark, "A", day, float(day)))
        a.upsert("confidence_signals", rows(spark, "B", day, float(day)))
    a.delete_ticker("A")
    b.upsert("confidence_signals", rows(spark, "A", 1, 9.0))  # of another writer, after the deletion
    want = {("A", 9.0), ("B", 2.0)}
    assert {(r["ticker"], r["score"]) for r in a.rows("confidence_signals").collect()} == want
    a.compact("confidence_signals")
    assert a.log("confidence_signals").count() == 2 and len(a._parts("confidence_signals")[0]) == 1
    a.delete_ticker("B")
    b.upsert("confidence_signals", rows(spark, "C", 1, 1.0))
    assert {(r["ticker"], r["score"]) for r in b.rows("confidence_signals").collect()} == {("A", 9.0), ("C", 1.0)}
    b.compact("confidence_signals")
    assert {(r["ticker"], r["score"]) for r in SignalStore(spark, str(tmp_path)).rows("confidence_signals").collect()} == {("A", 9.0), ("C", 1.0)}


def test_a_store_of_an_older_schema_reads_the_same(spark, tmp_path, monkeypatch):
    store = SignalStore(spark, str(tmp_path))
    narrative = schemas.declared("narrative_signals", 1, schemas.table_schema("narrative"))
    guidance = schemas.declared("guidance_signals", 1, schemas.table_schema("guidance"))
    assert "count_change" not in narrative and "tracked" not in guidance
    old = {"narrative_signals": spark.createDataFrame([], narrative).unionByName(spark.sql(
        "SELECT 'narr::A::Q1::2026' AS id, 'A' AS ticker, 'Q1' AS quarter, 2026 AS fiscal_year, timestamp_ntz'2026-01-01' AS generated_at, "
        "array(named_struct('theme', 'demand', 'status', 'stable', 'cur', 4, 'prev', 3, 'sentiment', 0.5D, 'prev_sentiment', 0.25D, 'key_quotes', array('q'))) AS themes"), allowMissingColumns=True),
        "guidance_signals": spark.createDataFrame([], guidance).unionByName(spark.sql("SELECT 'guid::A::Q1::2026' AS id, 'A' AS ticker, 'Q1' AS quarter, 2026 AS fiscal_year, timestamp_ntz'2026-01-01' AS generated_at, 2 AS beats, 1 AS misses, 0 AS in_line"), allowMissingColumns=True)}
    for table, df in old.items():
        df.write.partitionBy("fiscal_year").parquet(f"{store.path(table)}/added=old")
    store.commits.commit({"add": "old", "tables": list(old), "schema": 1})
    store.upsert("guidance_signals", spark.createDataFrame([("guidance::A::Q2::2026", "A", "Q2", 2026, dt.datetime(2026, 1, 2), 5, "high")], f"{KEY}, tracked int, reliability string"))

    def read():
        t = store.rows("narrative_signals").first()
        g = {r["id"]: (r["tracked"], r["reliability"]) for r in store.rows("guidance_signals").collect()}
        return t["id"], [x.asDict() for x in t["themes"]], g

    before = read()
    assert before[0] == "narrative::A::Q1::2026" and before[1][0]["count_change"] == 1 and before[1][0]["sentiment_change"] == 0.25
    assert before[2] == {"guidance::A::Q1::2026": (3, None), "guidance::A::Q2::2026": (5, "high")}
    for _ in range(2):
        for table in old:
            store.compact(table)
        assert read() == before
