"""Fiscal periods (April to March) as Column expressions.

``period_idx`` = fiscal_year * 4 + quarter - 1, so the quarter before is -1 and the same
quarter of the year before is -4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def quarter_number(date: Column) -> Column:
    return F.floor(F.pmod(F.month(date) - 4, F.lit(12)) / 3).cast("int") + 1


def fiscal_year(date: Column) -> Column:
    return F.year(date) + (F.month(date) >= 4).cast("int")


def period_idx(date: Column) -> Column:
    return fiscal_year(date) * 4 + quarter_number(date) - 1


def idx_of(quarter: Column, year: Column) -> Column:
    return year * 4 + F.substring(quarter, 2, 1).try_cast("int") - 1


def quarter_of(idx: Column) -> Column:
    return F.concat(F.lit("Q"), F.pmod(idx, F.lit(4)) + 1)


def year_of(idx: Column) -> Column:
    return F.floor(idx / 4).cast("int")


def format_period(quarter: Column, year: Column) -> Column:
    """'Q1 FY27'; a year that is no number is shown as it is."""
    number = year.try_cast("int")
    return F.when(number.isNotNull(), F.format_string("%s FY%02d", quarter, F.pmod(number, F.lit(100)))).otherwise(F.concat_ws(" ", quarter, year.cast("string")))


def parse_period(label: Column) -> Column:
    """struct(quarter, fiscal_year) of 'Q1 FY27' or 'Q1 2027'; the year is null if it is no number."""
    parts = F.split(F.trim(label), r"\s+")
    year = F.regexp_replace(F.get(parts, F.lit(1)), "(?i)^FY", "").try_cast("int")
    return F.struct(F.get(parts, F.lit(0)).alias("quarter"), F.when(year < 100, year + 2000).otherwise(year).alias("fiscal_year"))


def quarter_start(idx: Column) -> Column:
    months = (year_of(idx) - 1) * 12 + 3 + F.pmod(idx, F.lit(4)) * 3
    return F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def quarter_end(idx: Column) -> Column:
    """The last second of the quarter."""
    return quarter_start(idx + 1) - F.expr("INTERVAL 1 SECOND")


def search_window(idx: Column, now: Column, annual: bool = False, result_lag: int = 90, annual_lag: int = 200) -> Column:
    """struct(start, end): filings are looked for until the lag after the quarter, or ``now``."""
    lag = annual_lag if annual else result_lag
    start = quarter_start(idx)
    end = F.greatest(start, F.least(quarter_end(idx) + F.expr(f"INTERVAL {lag} DAYS"), now))
    return F.struct(start.alias("start"), end.alias("end"))


def last_ended(date: Column) -> Column:
    """The most recently ended fiscal quarter before ``date``."""
    return period_idx(date) - 1


_TAIL = r"(?:quarter|period|year|qtr)[^.]{0,40}?end(?:ed|ing)?\s+(?:on\s+)?(.{0,28})"
_MONTH = r"\b(" + "|".join(f"{name}|{'sept?' if name == 'september' else name[:3]}" for name in MONTHS) + r")\b"
_NUMERIC = r"\b\d{1,2}[./-](\d{1,2})[./-](\d{2,4})\b"
_DIRECT = r"\bq([1-4])\s*(?:fy|f\.y\.?|fiscal)\s*[\s\-]?(\d{2,4})\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def period_from_subject(subject: Column) -> Column:
    """period_idx named in a filing's subject, or null.

    A month's whole name or three letters (four for September) and a year, else a
    day-first numeric date, both after '... ended'; else 'Qn FYyy'.
    """
    return let(F.lower(F.coalesce(subject, F.lit(""))), lambda s: F.coalesce(let(F.regexp_extract(s, _TAIL, 1), _from_tail), let(F.regexp_extract(s, _DIRECT, 0), _from_label)))


def _from_tail(tail: Column) -> Column:
    number = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS) for x in (name[:3], i + 1)])
    month = F.element_at(number, F.substring(F.regexp_extract(tail, _MONTH, 1), 1, 3))
    four = F.regexp_extract(tail, r"\b(\d{4})\b", 1).try_cast("int")
    two = F.regexp_extract(tail, r"[\s,'](\d{2})\b", 1).try_cast("int")
    named = let(F.struct(F.coalesce(four, two + 2000).alias("y"), month.alias("m")), lambda d: F.when(d["m"].isNotNull() & d["y"].between(2000, 2100), _idx(d["y"], d["m"])))
    mon, raw = F.regexp_extract(tail, _NUMERIC, 1).try_cast("int"), F.regexp_extract(tail, _NUMERIC, 2).try_cast("int")
    dated = let(F.struct(F.when(raw < 100, raw + 2000).otherwise(raw).alias("y"), mon.alias("m")), lambda d: F.when(d["m"].between(1, 12) & d["y"].between(2000, 2100), _idx(d["y"], d["m"])))
    return F.when(tail != "", F.coalesce(named, dated))


def _from_label(found: Column) -> Column:
    q, year = F.substring(found, 2, 1).try_cast("int"), F.regexp_extract(found, r"(\d+)$", 1).try_cast("int")
    return F.when(found != "", F.when(year < 100, year + 2000).otherwise(year) * 4 + q - 1)


def _idx(year: Column, month: Column) -> Column:
    return (year + (month >= 4).cast("int")) * 4 + F.floor(F.pmod(month - 4, F.lit(12)) / 3).cast("int")


def document_period(subject: Column, event_date: Column, doc_type: Column | None = None) -> Column:
    """struct(period_idx, source): from the subject, else the quarter that ended before the filing.

    An annual report is always dated by its filing.
    """
    named = period_from_subject(subject)
    if doc_type is not None:
        named = F.when(F.coalesce(doc_type != "annual_report", F.lit(True)), named)
    both = F.struct(named.alias("named"), last_ended(event_date).alias("dated"))

    def choose(p: Column) -> Column:
        source = F.when(p["named"].isNotNull(), "subject").when(p["dated"].isNotNull(), "event_date").otherwise("unknown")
        return F.struct(F.coalesce(p["named"], p["dated"]).alias("period_idx"), source.alias("source"))

    return let(both, choose)
