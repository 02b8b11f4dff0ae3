"""The stream of shortlists against the same filings at once, in shuffled orders of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quartermark.sources import announcements
from quartermark.streaming import shortlist

SCHEMA = "ticker string, ordinal long, subject string, urls array<string>, event_date timestamp_ntz"
SUBJECTS = ["Transcript of earnings call", "Press Release quarter ended December 31, 2025", "Press Release quarter ended September 30, 2025", "Investor Presentation Q3 FY26", "Closure of trading window", "Annual Report 2024-25"]


def filings(n=120):
    rng = random.Random(3)
    out = []
    for i in range(n):
        day = dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 60))
        out.append((rng.choice("AB"), i, rng.choice(SUBJECTS), [f"u{rng.randint(0, 90)}"], day))
    return out


def listed(df):
    return {(r["ticker"], r["period_idx"], r["rank"], r["url"], r["ordinal"]) for r in df.collect()}


@pytest.mark.parametrize("seed, recency", [(0, "oldest"), (1, "newest")])
def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path, seed, recency):
    rows = filings()
    at_once = spark.createDataFrame(rows, SCHEMA)
    wanted = at_once.select(F.explode(F.array(*[F.lit(p) for p in range(8090, 8112)])).alias("period_idx")).distinct()
    kept = announcements.candidates(at_once.where("event_date is not null"), wanted, most=5, recency=recency, by=("ticker",))
    want = {(r["ticker"], r["period_idx"], r["rank"], r["url"], r["ordinal"]) for r in kept.collect()}
    random.Random(seed).shuffle(rows)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in range(3):
        spark.createDataFrame(rows[part::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        shortlist.start(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), most=5, recency=recency).awaitTermination()  # each start goes on where the last ended
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert listed(shortlist.latest_lists(changes)) == want and max(r[2] for r in want) == 5
    assert changes.select("version").distinct().count() > 2 and changes.where("closed").count() == 0


def test_a_quarter_closes_after_the_lag(spark, tmp_path):
    q3 = "Investor Presentation Q3 FY26"
    batches = [[("A", 1, q3, ["u1"], dt.datetime(2026, 1, 20))], [("A", 2, q3, ["u2"], dt.datetime(2026, 5, 1)), ("B", 3, q3, ["u3"], dt.datetime(2026, 5, 1))],
               [("A", 4, "Investor Presentation Q1 FY27", ["u4"], dt.datetime(2026, 9, 1))], [("A", 5, "Investor Presentation Q1 FY27", ["u5"], dt.datetime(2026, 9, 2))],
               [("A", 0, q3, ["u6"], dt.datetime(2026, 9, 3))]]  # too late for its quarter
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        shortlist.start(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), lag_days=200).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    last = shortlist.latest_lists(changes)
    assert listed(last.where("period_idx = 8106")) == {("A", 8106, 1, "u1", 1), ("A", 8106, 2, "u2", 2), ("B", 8106, 1, "u3", 3)}
    assert {(r["ticker"], r["closed"]) for r in last.where("period_idx = 8106").collect()} == {("A", True), ("B", True)}
    assert listed(last.where("period_idx = 8108")) == {("A", 8108, 1, "u4", 4), ("A", 8108, 2, "u5", 5)}


class Handle:
    """State of one key that counts its calls."""

    def __init__(self):
        self.calls, self.values, self.number, self.timers = 0, [], None, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def exists(self):
                outer.calls += 1
                return outer.number is not None

            def get(self):
                outer.calls += 1
                return (outer.number,)

            def update(self, value):
                outer.calls += 1
                outer.number = value[0]

        return Value()

    def exists(self):
        self.calls += 1
        return bool(self.values)

    def get(self):
        self.calls += 1
        return iter(self.values)

    def appendValue(self, value):
        self.calls += 1
        self.values.append(value)

    def put(self, values):
        self.calls += 1
        self.values = list(values)

    def clear(self):
        self.calls += 1
        self.values = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getCurrentProcessingTimeInMs(self):
        return 1

    def getExpiryTimeInMs(self):
        return 1000


def test_state_calls_do_not_follow_the_number_of_filings():
    """Thousands of filings take a few calls to the store, and one timer closes all quarters that have ended."""
    from pyspark.sql import Row

    handle, made = Handle(), shortlist.Shortlist(5)
    made.init(handle)
    rows = [Row(url=f"u{i}", ordinal=i, period_idx=8100 + i % 20, priority=i % 3, by_date=i, doc_type="x", ends=1000 * (1 + i % 20)) for i in range(4000)]
    out = list(made.handleInputRows(("A", 0), iter(rows), Times(0)))
    assert len(out) == 100 and handle.calls <= 6 and handle.timers == [1000]
    assert [r["url"] for r in out if r["period_idx"] == 8100] == ["u0", "u60", "u120", "u180", "u240"]
    moved = list(made.handleInputRows(("A", 0), iter([Row(url="u60", ordinal=1, period_idx=8101, priority=0, by_date=0, doc_type="x", ends=2000)]), Times(0)))
    assert [r["url"] for r in moved if r["period_idx"] == 8100] == ["u0", "u120", "u180", "u240", "u300"] and moved[5]["url"] == "u60" and {r["version"] for r in moved} == {2}
    handle.calls = 0
    closed = list(made.handleExpiredTimer(("A", 0), Times(15_001), Times(0)))
    assert {r["period_idx"] for r in closed} == set(range(8100, 8115)) and all(r["closed"] for r in closed)
    assert handle.calls <= 7 and handle.timers == [1000, 16_000] and len(made._held()) == 1000


def test_no_key_gets_all_filings_of_a_ticker(spark):
    t = spark.createDataFrame([("A", i, "Investor Presentation Q3 FY26", [f"u{i}"], dt.datetime(2026, 1, 20)) for i in range(500)], SCHEMA)
    sizes = [r["count"] for r in shortlist.dated(t, 200).groupBy("ticker", "part").count().collect()]
    assert sum(sizes) == 500 and max(sizes) < 30
