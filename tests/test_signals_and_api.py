import datetime as dt
import json

from pyspark.sql import functions as F

from quartermark.api import SignalApi
from quartermark.operators import signals, store
from quartermark.sources import caches, fetch, pdf


def test_guidance_signals(spark):
    rows = [("A", 8104, i, m, o) for i, (m, o) in enumerate([("Revenue", "beat"), ("margin", "miss"), (" Margin ", "miss"), ("capex", "in_line"), ("eps", "pending")])] + [("B", 8104, 0, "x", "pending")]
    got = {r["ticker"]: r for r in signals.guidance_signals(spark.createDataFrame(rows, "ticker string, period_idx int, position int, metric string, outcome string")).collect()}
    a, b = got["A"], got["B"]
    assert (a["beats"], a["in_line"], a["misses"], a["miss_streak"], a["serial_miss_metrics"]) == (1, 1, 2, True, ["margin"])
    assert a["score"] == round(100 * (1 + 0.8 + 1.5) / 7 - 10) and a["recent_pattern"] == ["beat", "miss", "miss", "in_line"]
    assert "Missed repeatedly: margin." in a["summary"]
    assert b["score"] is None and b["hit_rate"] is None and b["summary"].startswith("Guidance not assessed")


def test_narrative_and_risk_signals(spark):
    t = spark.createDataFrame([("A", 1, "deposit competition", 0, 4, 0.2), ("A", 2, "deposit competitions", 0, 9, 0.3), ("A", 2, "new plants", 1, 3, 0.1)], "ticker string, period_idx int, theme string, position int, cur int, sentiment double")
    table = signals.theme_table(t)
    got = {(r["period_idx"], r["theme"]): r for r in table.collect()}
    assert got[2, "deposit competitions"]["status"] == "accelerating" and got[2, "deposit competitions"]["prev"] == 4
    assert got[2, "new plants"]["status"] == "emerging" and got[2, "new plants"]["prior_available"] and not got[1, "deposit competition"]["prior_available"]
    n = {r["period_idx"]: r for r in signals.narrative_signals(table).collect()}
    assert n[2]["overall_shift"] == "positive" and n[2]["summary"] == "The narrative shift is positive: accelerating: deposit competitions; emerging: new plants."
    r = spark.createDataFrame([("A", 1, "fx", 0, 3, "HIGH"), ("A", 2, "fx", 0, 5, "odd"), ("A", 2, "fuel", 1, 1, "critical")], "ticker string, period_idx int, risk string, position int, cur int, severity string")
    table = signals.risk_table(r)
    s = {r["period_idx"]: r for r in signals.risk_signals(table).collect()}
    assert s[2]["direction"] == "increasing" and s[2]["new_risks"] == ["fuel"] and s[2]["escalating"] == ["fx"] and s[2]["worst_severity"] == "critical"
    assert [x["risk"] for x in signals.top_risks(table.where("period_idx = 2")).orderBy("rank").collect()] == ["fuel", "fx"]


def test_key_quotes(spark):
    items = spark.createDataFrame([(1, "A", 1, ["Margins rose “sharply” this year", "never said at all here", "Margins rose again and again"])], "id int, ticker string, period_idx int, quotes array<string>")
    evidence = spark.createDataFrame([("A", 1, 'We saw margins  rose "sharply" this year, and margins rose again and again.')], "ticker string, period_idx int, text string")
    assert signals.key_quotes(items, evidence).first()["key_quotes"] == ["Margins rose “sharply” this year"]


def fill(spark, path):
    s = store.SignalStore(spark, str(path))
    now = dt.datetime(2026, 1, 1)
    key = "id string, ticker string, quarter string, fiscal_year int, generated_at timestamp_ntz"
    s.upsert("confidence_signals", spark.createDataFrame([(f"c{i}", "A", f"Q{i}", 2026, now, 5.0 + i) for i in (1, 2, 4)], f"{key}, score double"))
    s.upsert("guidance_signals", spark.createDataFrame([("g1", "A", "Q1", 2026, now, 60.0, 2, 1, 1), ("g2", "A", "Q2", 2026, now, None, 0, 0, 0)], f"{key}, score double, beats int, misses int, in_line int"))
    risk = f"{key}, risks array<struct<risk:string,severity:string>>, new_risks array<string>, escalating array<string>, diminishing array<string>"
    full = [("r1", "A", "Q1", 2026, now, [("fx", "low"), ("fuel", "high")], ["fx", "fuel"], [], []), ("r2", "A", "Q2", 2026, now, [("fx", "critical")], ["fx"], [], ["fuel"])]
    rows = spark.createDataFrame(full, risk).withColumn("risks", F.transform("risks", lambda r: F.struct(
        r["risk"].alias("risk"), r["severity"].alias("severity"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("cur"), F.lit(0).alias("prev"), F.array().cast("array<string>").alias("key_quotes"))))
    s.upsert("risk_signals", rows)
    s.upsert("ingested_documents", spark.createDataFrame([("d1", "A", "Q1", 2026, "text", now)], "doc_id string, ticker string, quarter string, fiscal_year int, raw_text string, ingested_at timestamp_ntz"))
    return SignalApi(s)


def test_api(spark, tmp_path):
    api = fill(spark, tmp_path / "s")
    assert [r["quarter"] for r in api.signal_history("confidence", "a", 2).collect()] == ["Q4", "Q2"]
    assert {r["quarter"]: r["score_delta"] for r in api.all_periods("A").collect()} == {"Q1": None, "Q2": 1.0, "Q4": None}
    b = {r["quarter"]: r for r in api.bundles("A").collect()}
    assert b["Q1"]["guidance"]["score"] == 60.0 and b["Q4"]["guidance"] is None and b["Q2"]["guidance"]["score"] is None
    y = api.ytd_guidance("A").first()
    assert (y["beats"], y["tracked"], y["hit_rate"], y["quarters"]) == (2, 4, 0.75, ["Q1", "Q2"])
    r = api.ytd_risks("A").first()
    assert (r["new"], r["active"], r["diminishing"]) == (["fx", "fuel"], ["fx"], ["fuel"])
    assert api.document_text("d1").first()["raw_text"] == "text" and [x["ticker"] for x in api.tickers().collect()] == ["A"]
    assert api.coverage().where("has_confidence and not has_guidance").count() == 1
    assert api.comparison("A").where("period_idx = 8105").first()["confidence_score_qoq"] == 6.0
    assert json.loads(api.json(api.signal("guidance", "A", "Q2", 2026)).first()["json"])["score"] is None
    api.write_json(api.signal_history("confidence", "A"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert api.manifest("confidence", "A", "Q1", 2026).count() == 0 and api.evidence("confidence", "A", "Q1", 2026).count() == 1


def test_fetch_falls_back_through_addresses_and_caches(spark, tmp_path):
    (tmp_path / "b.txt").write_text("from the second address")
    c = spark.createDataFrame([("u1", ["/nowhere", str(tmp_path / "b.txt")]), ("u2", ["/nowhere"]), ("u3", ["/nowhere"]), ("u4", None), ("u5", ["/nowhere"])], "url string, urls array<string>")
    got = {r["url"]: r for r in fetch.download(c).collect()}
    assert got["u1"]["used"].endswith("b.txt") and got["u2"]["content"] is None and "Error" in got["u2"]["error"] and got["u4"]["error"] == "no address"
    parsed = caches.entries(spark.createDataFrame([("u3", "parsed before")], "url string, text string"), "v1", 25)
    raw = fetch.raw_entries(spark.createDataFrame([("u5", bytearray(b"raw before"))], "url string, content binary"))
    t = {r["url"]: (r["text"], r["how"]) for r in fetch.texts(c, parsed, raw, "v1", 25, cascade=(("plain", pdf.plain_bytes),)).collect()}
    assert t == {"u1": ("from the second address", "plain"), "u3": ("parsed before", "cache"), "u5": ("raw before", "plain")}
