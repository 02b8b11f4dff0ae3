"""Host-level quality rules.

Every document is measured and held against the rules; rule failures are counted by
host; each host's failure rate is shrunk towards all hosts by a beta prior fitted to the
hosts themselves (method of moments); a host whose shrunk rate exceeds HOST_LIMIT is
rejected as a whole, and that verdict is joined back to its documents.

Defined results: a null or empty text has no words and fails the base rule; documents
with a null host are one nameless group that is never rejected as a whole; repeated rows
count as often as they occur; columns of the input keep their names, and the verdicts
come in one struct column under a free name. Very long texts are measured whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, prepare, words_of

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Soft rules: symbols a word, repeated lines a line (a few at least), upper-case words, characters a word.
MAX_SYMBOL_RATIO = 0.1
MAX_DUP_LINE_RATIO = 0.3
MIN_DUP_LINES = 3
MAX_UPPER_RATIO = 0.5
MAX_WORD_LENGTH = 20.0
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Strength of the prior when hosts do not differ, and its bounds.
PRIOR_MIN, PRIOR_MAX = 5.0, 1000.0
#: Words measured at a time; a longer text is measured alone.
CHUNK_WORDS = 200_000
#: Host tables of at most this many rows are broadcast.
BROADCAST_HOSTS = 20_000

FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper_words long"


def repeated_window_words(lists: list[list[str]], window: int = WINDOW) -> list[int]:
    """For each list, how many of its words lie in a window that occurs in it at least twice."""
    import numpy as np

    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(lists), dtype=np.int64)
    if total < window:
        return out.tolist()
    codes = pd.factorize(np.array([w for x in lists for w in x], dtype=object))[0].astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    span = 1
    while span < window:  # windows of 2, 4, 8 words, each named by the pair of its halves
        codes = codes[:-span] * (int(codes.max()) + 1) + codes[span:] if len(codes) > span else codes[:0]
        codes = pd.factorize(codes)[0].astype(np.int64)
        span *= 2
    starts = np.flatnonzero(owner[: len(codes)] == owner[window - 1: window - 1 + len(codes)])
    keys = pd.factorize(codes[starts] * len(lists) + owner[starts])[0]
    again = starts[np.bincount(keys, minlength=1)[keys] >= 2] if len(keys) else starts
    if len(again):
        edge = np.zeros(total + 1, dtype=np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        out += np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(lists))
    return out.tolist()


def _lines(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: pd.Series) -> pd.DataFrame:
    import re

    upper = re.compile(r"(?<![^ \t-\r])[^a-z \t-\r]*[A-Z][^a-z \t-\r]*(?![^ \t-\r])")
    rows, waiting, held, repeats = [], [], 0, []
    for text in texts:
        text = text or ""
        words = words_of(text)
        if waiting and held + len(words) > CHUNK_WORDS:
            repeats += repeated_window_words(waiting)
            waiting, held = [], 0
        waiting.append(words)
        held += len(words)
        n_lines, n_dup = _lines(text)
        rows.append((len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), n_lines, n_dup, 0, len(upper.findall(text))))
    repeats += repeated_window_words(waiting)
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")], dtype="int64")
    out["n_repeat_words"] = pd.Series(repeats, dtype="int64")
    return out


def base_failed(f):
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def soft_failed(f):
    return (
        (f["n_symbols"] > MAX_SYMBOL_RATIO * f["n_words"])
        | ((f["n_dup_lines"] >= MIN_DUP_LINES) & (f["n_dup_lines"] > MAX_DUP_LINE_RATIO * f["n_lines"]))
        | (f["n_upper_words"] > MAX_UPPER_RATIO * f["n_words"])
        | (f["word_chars"] > MAX_WORD_LENGTH * f["n_words"])
    )


def host_rates(measured: DataFrame, host: str, failed) -> DataFrame:
    """(host, n, failures, rate): rate is shrunk by a beta prior fitted to all named hosts."""
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failures"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("h"),
                      F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("q")).first()
    alpha, beta = fit_beta(total["n"] or 0, total["f"] or 0, total["h"], total["q"] or 0.0)
    return hosts.withColumn("rate", (F.col("failures") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))


def fit_beta(n: int, failures: int, hosts: int, squares: float) -> tuple[float, float]:
    """Method of moments; ``squares`` is the sum over hosts of failures² / documents."""
    if not n:
        return 1.0, 1.0
    mean = (failures + 0.5) / (n + 1.0)
    spread = squares / n - (failures / n) ** 2  # between hosts, weighted by documents
    chance = mean * (1 - mean) * hosts / n
    between = spread - chance
    strength = PRIOR_MAX if between <= 0 else min(PRIOR_MAX, max(PRIOR_MIN, mean * (1 - mean) / between - 1))
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_text: bool = False) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with a struct column of measures and verdicts, and its name.

    The rows are written once to the shared folder with their measures (without the text
    unless ``keep_text``), since both the host rates and the verdicts read them.
    """
    prepare(docs.sparkSession)
    f = free_name(docs, "rules")
    wide = docs.withColumn(f, F.pandas_udf(measure, FEATURES)(F.col(text)))
    measured = materialise(wide if keep_text else wide.drop(text), "rules")
    failed = base_failed(F.col(f)) | soft_failed(F.col(f))
    rates = materialise(host_rates(measured, host, failed), "hosts")
    name, rate = free_name(docs, "host"), free_name(docs, "rate")
    verdicts = rates.select(F.col("host").alias(name), F.col("rate").alias(rate))
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = measured.join(verdicts, measured[host] == F.col(name), "left")
    rejected = F.coalesce(F.col(rate) > HOST_LIMIT, F.lit(False))
    found = F.struct(
        F.col(f"{f}.*"), base_failed(F.col(f)).alias("base_failed"), soft_failed(F.col(f)).alias("soft_failed"),
        F.col(rate).alias("host_rate"), rejected.alias("host_rejected"), (~(failed | rejected)).alias("kept"))
    return joined.withColumn(f, found).drop(name, rate), f
