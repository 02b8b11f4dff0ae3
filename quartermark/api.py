"""The read side: named queries over a store, as DataFrames or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import periods
from .functions.numbers import py_round
from .operators import aggregates, compare
from .operators.store import SignalStore, history

KINDS = ("confidence", "narrative", "guidance", "risk")
KEYS = ["ticker", "quarter", "fiscal_year"]


class SignalApi:
    def __init__(self, store: SignalStore):
        self.store = store

    def _rows(self, kind: str) -> DataFrame:
        rows = self.store.rows(f"{kind}_signals")
        return rows.withColumn("period_idx", periods.idx_of(F.col("quarter"), F.col("fiscal_year")))

    def signal_history(self, kind: str, ticker: str, limit: int = 8) -> DataFrame:
        rows = self.store.rows(f"{kind}_signals")
        return history(rows, rows.columns, ticker.upper(), limit)

    def signal(self, kind: str, ticker: str, quarter: str, fiscal_year: int) -> DataFrame:
        asked = (F.col("ticker") == ticker.upper()) & (F.col("quarter") == quarter) & (F.col("fiscal_year") == fiscal_year)
        return self.store.rows(f"{kind}_signals").where(asked)

    def document_text(self, doc_id: str) -> DataFrame:
        return self.store.rows("ingested_documents").where(F.col("doc_id") == doc_id).select("doc_id", "raw_text")

    def documents(self, ticker: str, quarter: str | None = None, fiscal_year: int | None = None, limit: int = 50) -> DataFrame:
        return self.store.documents(ticker.upper(), quarter, fiscal_year, limit)

    def manifest(self, kind: str, ticker: str, quarter: str, fiscal_year: int) -> DataFrame:
        return self.store.rows("signal_manifests").where(F.col("id") == f"{kind}::{ticker.upper()}::{quarter}::{fiscal_year}")

    def tickers(self) -> DataFrame:
        return self.store.log("ingested_documents").select("ticker").distinct().orderBy("ticker")

    def bundles(self, ticker: str) -> DataFrame:
        mine = {k: self._rows(k).where(F.col("ticker") == ticker.upper()) for k in KINDS}
        plain = [*KEYS, "period_idx"]
        others = {k: mine[k].select(*plain, *[c for c in mine[k].columns if c not in (*plain, "id", "company", "generated_at")]) for k in KINDS[1:]}
        return compare.bundle(mine["confidence"], others, tuple(plain))

    def comparison(self, ticker: str) -> DataFrame:
        """Latest, QoQ and YoY confidence and guidance scores of every period."""
        b = self.bundles(ticker).select("ticker", "period_idx", F.col("score").alias("confidence_score"), F.col("guidance.score").alias("guidance_score"))
        return compare.comparison(b, ["confidence_score", "guidance_score"])

    def all_periods(self, ticker: str) -> DataFrame:
        rows = self._rows("confidence").where(F.col("ticker") == ticker.upper())
        rows = compare.gap_safe_delta(rows.select("ticker", "quarter", "fiscal_year", "period_idx", "score"), "score")
        return rows.withColumn("label", periods.format_period(F.col("quarter"), F.col("fiscal_year"))).orderBy(F.desc("period_idx"))

    def ytd_guidance(self, ticker: str) -> DataFrame:
        return aggregates.ytd_guidance(self._rows("guidance").where(F.col("ticker") == ticker.upper()))

    def ytd_risks(self, ticker: str) -> DataFrame:
        rows = self._rows("risk").where(F.col("ticker") == ticker.upper())
        severity = F.map_from_entries(F.array_distinct(F.transform("risks", lambda r: F.struct(r["risk"], r["severity"]))))
        named = None
        for kind, column in (("new", "new_risks"), ("escalating", "escalating"), ("diminishing", "diminishing")):
            part = rows.select("ticker", "fiscal_year", F.col("quarter").alias("q"), severity.alias("s"), F.posexplode(column).alias("pos", "risk"))
            part = part.select("ticker", "fiscal_year", "q", "pos", F.lit(kind).alias("list"), "risk", F.coalesce(F.element_at("s", F.col("risk")), F.lit("medium")).alias("severity"))
            named = part if named is None else named.unionByName(part)
        return aggregates.ytd_risks(named)

    def coverage(self) -> DataFrame:
        return compare.coverage({k: self._rows(k) for k in KINDS})

    def summary_table(self, ticker: str | None = None) -> DataFrame:
        """A row a signal and period: its score or label, the colour of its band, and the key finding."""
        def of(kind):
            rows = self._rows(kind)
            return rows if ticker is None else rows.where(F.col("ticker") == ticker.upper())

        def cut(column, n):
            return F.concat(F.substring(column, 1, n), F.when(F.length(column) > n, "…").otherwise(""))

        def band(score, high, low):
            return F.when(score >= high, "green").when(score >= low, "yellow").otherwise("red")

        def colour(column, table):
            pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
            return F.coalesce(F.element_at(pairs, F.col(column)), F.lit("dim"))

        key = [*KEYS, "period_idx"]
        c = compare.gap_safe_delta(of("confidence").select(*key, "score", "summary"), "score")
        change = F.coalesce(F.format_string(" (%+.1f QoQ)", py_round(F.col("score_delta"), 1)), F.lit(""))
        told = [c.select(*key, F.lit("Management Confidence").alias("signal"), F.concat(F.format_string("%.1f/10", py_round(F.col("score"), 1)), F.when(F.col("score_delta").isNull(), "").otherwise(change)).alias("status"),
                         band(F.col("score"), 7, 5).alias("band"), cut(F.col("summary"), 100).alias("finding"))]
        told.append(of("narrative").select(*key, F.lit("Narrative Shift").alias("signal"), F.upper("overall_shift").alias("status"), colour("overall_shift", {"positive": "green", "negative": "red", "mixed": "yellow"}).alias("band"), cut(F.col("summary"), 100).alias("finding")))
        told.append(of("guidance").select(*key, F.lit("Guidance Credibility").alias("signal"), F.when(F.col("score").isNull(), "— not assessed").otherwise(F.format_string("%.0f/100", py_round(F.col("score"), 0))).alias("status"),
                                          F.when(F.col("score").isNull(), "dim").otherwise(band(F.col("score"), 70, 50)).alias("band"), cut(F.col("summary"), 100).alias("finding")))
        counts = F.format_string("%d new · %d escalating — ", *[F.size(F.coalesce(x, F.array().cast("array<string>"))) for x in ("new_risks", "escalating")])
        told.append(of("risk").select(*key, F.lit("Risk Emergence").alias("signal"), F.upper("direction").alias("status"), colour("direction", {"increasing": "red", "stable": "yellow", "decreasing": "green"}).alias("band"),
                                      F.concat(counts, F.substring("summary", 1, 70), F.lit("…")).alias("finding")))
        out = told[0]
        for rows in told[1:]:
            out = out.unionByName(rows)
        return out

    def evidence(self, kind: str, ticker: str, quarter: str, fiscal_year: int, quotes: int = 2, cited: int = 8) -> DataFrame:
        """Summary, the first three drivers, the first quoted citations and the first citations of one signal."""
        quoted = F.filter("citations", lambda c: F.length(F.coalesce(c["quote"], F.lit(""))) > 0)
        rows = self.signal(kind, ticker, quarter, fiscal_year)
        drivers = F.slice("drivers", 1, 3) if "drivers" in rows.columns else F.array().cast("array<string>")
        return rows.select("summary", drivers.alias("drivers"), F.slice(quoted, 1, quotes).alias("quotes"), F.slice("citations", 1, cited).alias("citations"))

    @staticmethod
    def json(rows: DataFrame) -> DataFrame:
        """One JSON text a row, nulls kept."""
        return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))

    @staticmethod
    def write_json(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
