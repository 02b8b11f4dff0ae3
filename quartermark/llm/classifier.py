"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Features are hashed unigrams and bigrams of tokens (runs of word characters, runs of
other characters) together with their shapes; a bigram of equal tokens has a bucket of
its own. A feature's value is its share of the document's features, so a document's score
is a sparse dot product divided by its feature count, whatever its length.

Training reads the whole texts of at most ``most`` labelled rows (MAX_LABELLED unless told
otherwise; those with the least hash of the id), in one task that holds the weights and one
row at a time: the rows come to it once an epoch, sorted. Every text is scored whole.
Defined results: a null or empty text scores by the bias alone; rows with a null label or
id teach nothing; with no labelled row at all every score is the neutral 0.5; conflicting
labels of one id all count, equal rows of one id and label once an epoch; repeated rows are
scored one by one; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, remainder

BITS = 18
#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 6000
SCALE = 20.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 0.1, 0.02, 0.1, 3
TOKENS = re.compile(r"\w+|[^\w\s]+")
MASK = (1 << BITS) - 1
THRESHOLD = 0.7


def _code(token: str) -> tuple[int, int]:
    """(hash of the token, hash of its shape)"""
    shape = "U" if token.isupper() and len(token) > 1 else "T" if token[:1].isupper() else "l" if token[:1].isalpha() else token[:2]
    return zlib.crc32(token.encode()) & 0xFFFFFFFF, zlib.crc32(shape.encode()) & 0xFFFFFFFF


class Hasher:
    """Buckets of a text's features; token hashes are remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.ids: dict[str, int] = {}
        self.most, self.hashes, self.shapes = most, [], []

    def buckets(self, text: str) -> np.ndarray:
        tokens = TOKENS.findall(text)
        if not tokens:
            return np.zeros(0, dtype=np.int64)
        if len(self.ids) > self.most:
            self.ids, self.hashes, self.shapes = {}, [], []
        ids = self.ids
        codes = np.fromiter(map(ids.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        if (codes < 0).any():
            for i in np.flatnonzero(codes < 0):
                t = tokens[i]
                if t not in ids:
                    ids[t] = len(self.hashes)
                    a, b = _code(t)
                    self.hashes.append(a)
                    self.shapes.append(b)
                codes[i] = ids[t]
        distinct, back = np.unique(codes, return_inverse=True)
        word = np.array([self.hashes[i] for i in distinct.tolist()], dtype=np.uint64)[back]
        shape = np.array([self.shapes[i] for i in distinct.tolist()], dtype=np.uint64)[back]
        out = [word * np.uint64(0x9E3779B1), shape * np.uint64(0x85EBCA77) + np.uint64(1)]
        if len(word) > 1:
            pair = word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:] * np.uint64(0x27D4EB2F165667C5)
            out.append(np.where(word[:-1] == word[1:], np.uint64(0x5BD1E995), pair))
            out.append(shape[:-1] * np.uint64(0x2545F4914F6CDD1D) + shape[1:] * np.uint64(0x9E3779B97F4A7C15))
        mixed = np.concatenate(out)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) & np.uint64(MASK)).astype(np.int64)


def train_ftrl(rows) -> np.ndarray:
    """Weights of 2**BITS buckets and the bias, from (buckets, counts, total, label) rows in turn."""
    z, n = np.zeros(MASK + 2), np.zeros(MASK + 2)
    for at, count, total, label in rows:
        x = np.append(count * (SCALE / total) if total else count[:0].astype(float), 1.0)
        at = np.append(at, MASK + 1)
        zi, ni = z[at], n[at]
        wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
        g = (p - label) * x
        z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
        n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _featurise(batches):
    hasher, done = Hasher(), set()
    for pdf in batches:
        rows = []
        for key, label, text in pdf.itertuples(index=False):
            if key in done:  # at most MAX_LABELLED ids are here; an id's equal rows teach once
                continue
            done.add(key)
            found = hasher.buckets(text or "")
            at, count = np.unique(found, return_counts=True)
            rows.append((key, label, at.astype("int32").tobytes(), count.astype("int32").tobytes(), len(found)))
        yield pd.DataFrame(rows, columns=["key", "label", "at", "count", "total"])


def _fit(batches):
    taught = False

    def rows():
        nonlocal taught
        last = None
        for pdf in batches:
            for epoch, key, label, at, count, total in pdf.itertuples(index=False):
                if (epoch, key) != last:
                    last, taught = (epoch, key), True
                    yield np.frombuffer(at, dtype="int32").astype(np.int64), np.frombuffer(count, dtype="int32"), total, label

    weights = train_ftrl(rows())
    if taught:
        yield pd.DataFrame({"weights": [weights.astype("float64").tobytes()]})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED, epochs: int = EPOCHS) -> np.ndarray:
    """Fit on a sample of ``most`` rows of ``labels`` and the texts of their documents."""
    prepare(docs.sparkSession)
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label"))
        .where("id is not null and label in (0, 1)")
        .orderBy(F.xxhash64("id"), "id", "label").limit(most)
    )
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sample = known.join(F.broadcast(chosen.distinct()), "id").select(F.xxhash64("id", "label", "text").alias("key"), "label", "text")
    features = sample.mapInPandas(_featurise, "key long, label double, at binary, count binary, total long")
    # in one task, which is bounded by ``most`` and in an order that hangs on no partitioning
    passes = features.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).select("epoch", "key", "label", "at", "count", "total")
    fitted = passes.repartition(1).sortWithinPartitions("epoch", "key").mapInPandas(_fit, "weights binary").collect()
    return np.frombuffer(fitted[0]["weights"]) if fitted else np.zeros(MASK + 2)


def with_score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score column under a free name, and that name."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, hasher, out = model.value, Hasher(), []
        for value in texts:
            found = hasher.buckets(value or "")
            dot = w[found].sum() * (SCALE / len(found)) if len(found) else 0.0
            out.append(1 / (1 + np.exp(-np.clip(dot + w[-1], -35, 35))))
        return pd.Series(out, dtype="float64")

    out = free_name(docs, "score")
    return docs.withColumn(out, score(F.col(text))), out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); a quarter of the ids never teaches."""
    weights = train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    scored, s = with_score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col(s).alias("score"),
                         (F.col(s) >= THRESHOLD).cast("int").alias("predicted"))
