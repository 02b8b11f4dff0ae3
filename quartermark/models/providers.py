"""Providers: completions, embeddings, tone, narration; each is a partition function or a UDF."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars a million tokens (input, output) by model.
PRICES = {
    "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60),
    "gpt-5.6-luna": (1.00, 6.00), "gpt-5.6-terra": (2.50, 15.00), "gpt-5.6-sol": (5.00, 30.00),
}
TONE = {"positive": 1.0, "confident": 1.0, "negative": -1.0, "cautious": -1.0, "neutral": 0.0}


def rule_completer(system: str, user: str) -> str:
    """The offline completer: counts of hedging and superlative words as JSON."""
    words = user.lower().split()
    hedges = sum(w.strip(".,") in {"may", "might", "could", "approximately"} for w in words)
    strong = sum(w.strip(".,") in {"record", "best", "strongest"} for w in words)
    return json.dumps({"hedging_markers": hedges, "superlative_terms": strong, "words": len(words)})


def complete(prompts: DataFrame, completer: Callable[[str, str], str] = rule_completer, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """``prompts`` (id, system, user) with payload, ok, error and attempts; a bad row fails no task."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, system, user in pdf[["id", "system", "user"]].itertuples(index=False):
                payload, error, tried = None, None, 0
                for tried in range(1, attempts + 1):
                    try:
                        payload, error = completer(system, user), None
                        break
                    except Exception as e:  # the provider's errors are results here
                        error = f"{type(e).__name__}: {e}"
                        if tried < attempts:
                            time.sleep(min(16.0, wait * 2 ** (tried - 1)))
                rows.append((key, payload, payload is not None, error, tried))
            yield pd.DataFrame(rows, columns=["id", "payload", "ok", "error", "attempts"])

    return prompts.select("id", "system", "user").mapInPandas(run, "id string, payload string, ok boolean, error string, attempts int")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """The offline embedding: hashed word counts, scaled to length one."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return pd.Series(out)

    return F.pandas_udf(run, "array<float>")(text)


def tone_value(label: Column) -> Column:
    out = F.lit(0.0)
    for name, value in TONE.items():
        out = F.when(F.lower(label) == name, value).otherwise(out)
    return out


def price_join(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Each call with the price of its model: exact name, else the longest name that begins it."""
    names = prices.select(F.col("model").alias("__name"), "price_in", "price_out")
    hits = calls.select(model).distinct().join(F.broadcast(names), F.col(model).startswith(F.col("__name")))
    best = hits.groupBy(model).agg(F.max_by(F.struct("price_in", "price_out"), F.length("__name")).alias("__p"))
    return calls.join(best, model, "left").select(*calls.columns, "__p.price_in", "__p.price_out")


def cost_summary(priced: DataFrame) -> DataFrame:
    cost = F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    return priced.agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
                      F.sum(cost).alias("cost"), F.bool_or(F.col("price_in").isNull()).alias("unpriced"))


def narrate(facts: DataFrame, cache: DataFrame, completer: Callable | None = None, version: str = "1") -> DataFrame:
    """``facts`` (id, headline, drivers, fallback) with prose: cached, else written, else the fallback."""
    key = F.substring(F.sha2(F.to_json(F.struct("drivers", "headline", F.lit(version).alias("v"))).cast("binary"), 256), 1, 16)
    keyed = facts.withColumn("fingerprint", key)
    joined = keyed.join(cache.select("fingerprint", F.col("prose").alias("__cached")).dropDuplicates(["fingerprint"]), "fingerprint", "left")
    if completer is None:
        return joined.select(*keyed.columns, F.coalesce("__cached", "fallback").alias("prose"), F.col("__cached").isNotNull().alias("cached"))
    asked = joined.where("__cached is null").select("id", F.lit("Write two sentences from these facts.").alias("system"), F.concat_ws("\n", "headline", F.array_join("drivers", "\n")).alias("user"))
    written = complete(asked, completer).select("id", F.col("payload").alias("__new"))
    return joined.join(written, "id", "left").select(*keyed.columns, F.coalesce("__cached", "__new", "fallback").alias("prose"), F.col("__cached").isNotNull().alias("cached"))
