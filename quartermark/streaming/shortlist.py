"""The shortlist of each quarter as a stream: at most ``most`` filings a ticker and quarter, whatever order they arrive in.

State is kept by ticker and part, a hash of the filing's address: its filings, as long as their
quarter is open. So no key gets all filings of a ticker, and an address still has one place. State is
read and written in lists, not filing by filing: those that are new or earlier are appended as one
value, and of an address's entries that with the least number counts. Each part gives out its own capped list
of a quarter; the quarter's list is the first ``most`` of its parts' lists (``latest_lists``).
A filing that arrives late takes its place by rank, and the lists that it changes are given out
again under a higher version; an address counts for the quarter of its first filing by number. A
quarter closes once the watermark has passed its end: the watermark stays ``lag_days`` behind the
latest filing, so filings may be that late. Its lists are then given out as closed and its filings
leave the state. The latest version of each list is what ``candidates`` gives for the same filings at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import periods, text
from ..operators.store import latest_by

#: Rows of a part's list: ``rank`` is within the part, a row without an address says that the list is empty now.
LISTED = "ticker string, part int, period_idx int, version long, closed boolean, rank int, most int, priority int, by_date long, url string, ordinal long, doc_type string, event_date timestamp"
HELD = ("url", "ordinal", "period_idx", "priority", "by_date", "doc_type", "ends")
#: Parts of a ticker's addresses.
PARTS = 128
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(rows: list[tuple]) -> bytes:
    """Rows as one Arrow stream: a call of the state store costs about the same for one filing as for thousands."""
    import pyarrow as pa

    kinds = {"url": pa.string(), "doc_type": pa.string()}
    batch = pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.int64())) for c, x in zip(HELD, zip(*rows, strict=True), strict=True)], names=list(HELD))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[tuple]:
    import pyarrow as pa

    found = pa.ipc.open_stream(data).read_all()
    return list(zip(*[c.to_pylist() for c in found.columns], strict=True))


class Shortlist(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.handle = handle
        self.filings = handle.getListState("filings", "rows binary")
        self.version = handle.getValueState("version", "version long")

    def _held(self) -> dict[str, tuple]:
        held: dict[str, tuple] = {}
        if self.filings.exists():
            for (data,) in self.filings.get():
                for x in unpacked(data):
                    if x[0] not in held or x[1] < held[x[0]][1]:
                        held[x[0]] = x
        return held

    def _lists(self, key, held, asked: set[int], closed: bool, now: int):
        from pyspark.sql import Row

        version = max(self.version.get()[0] + 1 if self.version.exists() else 1, now)
        self.version.update((version,))
        lists: dict[int, list] = {p: [] for p in asked}
        for x in held:
            if x[2] in lists:
                lists[x[2]].append((x[3], x[4], x[1], x))
        for period, rows in sorted(lists.items()):
            head = {"ticker": key[0], "part": key[1], "period_idx": period, "version": version, "closed": closed, "most": self.most}
            for n, (priority, by_date, ordinal, x) in enumerate(sorted(rows)[: self.most]):
                yield Row(**head, rank=n + 1, priority=priority, by_date=by_date, url=x[0], ordinal=ordinal, doc_type=x[5])
            if not rows:  # its filings belong to other quarters now
                yield Row(**head, rank=0, priority=None, by_date=None, url=None, ordinal=None, doc_type=None)

    def handleInputRows(self, key, rows, timerValues):
        held, new, changed = self._held(), {}, set()
        timed = min((x[6] for x in held.values()), default=None)
        now = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r.ends < now:  # a closed quarter
                continue
            old = held.get(r.url)
            if old is not None and old[1] <= r.ordinal:
                continue
            changed |= {r.period_idx} | ({old[2]} if old is not None else set())
            held[r.url] = new[r.url] = (r.url, r.ordinal, r.period_idx, r.priority, r.by_date, r.doc_type, r.ends)
        if changed:
            self.filings.appendValue((packed(list(new.values())),))
            first = min(x[6] for x in new.values())
            if timed is None or first < timed:  # a key waits for the first end of its filings' quarters alone
                self.handle.registerTimer(first)
            yield from self._lists(key, held.values(), changed, False, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ended = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)  # all that have ended close at once
        held = self._held().values()
        gone, kept = [x for x in held if x[6] <= ended], [x for x in held if x[6] > ended]
        if gone:
            yield from self._lists(key, gone, {x[2] for x in gone}, True, timerValues.getCurrentProcessingTimeInMs())
        if kept:
            self.filings.put([(packed(kept),)])
            self.handle.registerTimer(min(x[6] for x in kept))
        else:
            self.filings.clear()

    def close(self) -> None:
        pass


def dated(announcements: DataFrame, lag_days: int, newest: bool = False, parts: int = PARTS) -> DataFrame:
    """Classified and dated announcements (ticker, ordinal, subject, urls, event_date) as the shortlist takes them."""
    kind = text.classify(F.col("subject"))
    rows = announcements.withColumn("doc_type", kind).where("doc_type is not null and event_date is not null")
    period = periods.document_period(F.col("subject"), F.col("event_date"), F.col("doc_type"))["period_idx"]
    # exploded, so that filters and later columns take the period as it is instead of working it out again
    rows = rows.select("*", F.col("event_date").cast("timestamp").alias("event_time"), F.explode(F.array(period)).alias("period_idx"))
    ends = F.unix_millis(periods.quarter_end(F.col("period_idx")).cast("timestamp"))
    by_date = F.unix_micros("event_time") * (-1 if newest else 1)
    url = F.get("urls", F.lit(0))
    rows = rows.where("period_idx is not null").select(
        "ticker", F.pmod(F.xxhash64(url), F.lit(parts)).cast("int").alias("part"), F.col("ordinal").cast("long").alias("ordinal"), url.alias("url"), "period_idx",
        text.type_priority(F.col("doc_type")).cast("int").alias("priority"), by_date.alias("by_date"), "doc_type", ends.alias("ends"), "event_time")
    return rows.where("url is not null").withWatermark("event_time", f"{lag_days} days")


def shortlists(announcements: DataFrame, most: int = 15, lag_days: int = 200, recency: str = "oldest", parts: int = PARTS) -> DataFrame:
    """Changes of the parts' lists (LISTED) of a stream of announcements; state stores must be RocksDB ones."""
    announcements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    newest = recency == "newest"
    fields = LISTED.split(", ")
    rows = dated(announcements, lag_days, newest, parts).groupBy("ticker", "part").transformWithState(Shortlist(most), ", ".join(fields[:-1]), "Update", "EventTime")
    return rows.withColumn("event_date", F.timestamp_micros(F.col("by_date") * (-1 if newest else 1)))


def latest_lists(changes: DataFrame) -> DataFrame:
    """The last version of each quarter's list, without those that have become empty."""
    of_part = ["ticker", "period_idx", "part"]
    newest = latest_by(changes.select(*of_part, "version").distinct(), of_part, F.desc("version"))
    rows = changes.join(newest, [*of_part, "version"], "left_semi").where("rank > 0")
    place = F.row_number().over(Window.partitionBy("ticker", "period_idx").orderBy("priority", "by_date", "ordinal"))
    return rows.withColumn("rank", place).where("rank <= most").drop("part", "most", "priority", "by_date")


def start(spark: SparkSession, announcements: DataFrame, folder: str, checkpoint: str, once: bool = True, **kw):
    """Append the changes of the lists to the table in ``folder``; a batch that is run again replaces what it wrote."""
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = shortlists(announcements, **kw).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
