"""Soft-membership mixing of documents to target domain weights, in DataFrame operations.

A classifier learnt from a labelled table (naive Bayes over hashed words and hashed last
three letters of words) gives every document a posterior over domains. Documents then get
nonnegative rates r so that the expected tokens of domain k, the sum over documents of
r · tokens · posterior_k, match the targets in the least-squares sense, weighted by
1 / target, with a small pull of r towards 1. The fit is projected gradient with lazy
projection: the gradient for a document is its posterior times the relative errors of the
domains, so the steps' sum for all documents is one number a domain (``lean``), and the rate
of a document is its projection, max(0, 1 + posterior · lean), of its own exact posterior.
A step is one distributed sum over all documents at the present lean, of the totals and of
the domains' overlaps among documents of positive rate (k x k numbers), which scale the step;
one that goes too far is taken again with the overlaps of all documents. Steps run until every
domain is CLOSE to its target or the totals stand still: a target that no document can reach
moves rates little (DAMP). Nothing is pooled or rounded, at any number of domains.
``totals`` tells what was wanted and what is reached; the driver sees one total a domain
and the classifier's counts (BUCKETS at most a domain).

Defined results: a null or empty text has no tokens and the prior as its posterior; rows
with a null id or domain teach nothing; a domain without labelled rows keeps only smoothed
evidence; an empty table gives an empty result; repeated rows get equal rates; an id's
fraction of a copy is decided by a hash, alike at every size. Other columns are kept, the
result is one struct column under a free name.
"""

from __future__ import annotations

import json
import math
import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

#: Buckets of the hashed words, and as many of the last LAST letters.
BUCKETS, LAST = 1 << 14, 3
#: Labelled rows that the classifier learns from, at most.
MAX_LABELLED = 20_000
#: Pull of rates towards 1 (a rate r leaves a relative error of PULL · (r - 1)), and the relative error of a domain to stop at.
PULL, CLOSE = 1e-6, 1e-3
#: A domain with less than DAMP of its target is moved to it by more than one step.
DAMP = 1e-2
#: Steps (passes over the table of posteriors) at most, and the change of relative errors that is none.
STEPS, STILL = 100, 1e-4
#: Rates have no bound unless the caller asks for one.
MAX_RATE = sys.float_info.max
TARGETS = {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11}
#: White space becomes a blank, A-Z become a-z.
FROM = "\t\n\x0b\x0c\r" + "".join(map(chr, range(65, 91)))
TO = "     " + "".join(map(chr, range(97, 123)))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), FROM, TO), " "), "")


def buckets(found: Column) -> Column:
    """The features of an array of words: a bucket of each word, and one of its last letters."""

    def bucket(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")

    return F.concat(F.transform(found, bucket), F.transform(found, lambda w: bucket(F.substring(w, -LAST, LAST)) + BUCKETS))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> tuple[list[float], list[list[float]]]:
    """Log priors, and log feature probabilities a domain, from ``most`` rows of ``labelled`` (id, domain)."""
    known = labelled.select(F.col(labelled.columns[0]).alias("__id"), F.col(labelled.columns[1]).alias("__domain")).where("__id is not null").where(F.col("__domain").isin(domains))
    chosen = known.distinct().orderBy(F.xxhash64("__id"), "__id", "__domain").limit(most)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    # a row's first feature stands for the row itself
    seen = rows.select("__domain", F.explode(F.concat(F.array(F.lit(-1)), buckets(words(F.col("__text"))))).alias("b"))
    counts = {(r["__domain"], r["b"]): r["n"] for r in seen.groupBy("__domain", "b").agg(F.count("*").alias("n")).collect()}
    total = sum(n for (_, b), n in counts.items() if b < 0)
    priors, logs = [], []
    for d in domains:
        own = [counts.get((d, b), 0) for b in range(2 * BUCKETS)]
        mass = [sum(own[:BUCKETS]) + BUCKETS, sum(own[BUCKETS:]) + BUCKETS]
        priors.append(math.log((counts.get((d, -1), 0) + 1) / (total + len(domains))))
        logs.append([round(math.log((n + 1) / mass[b >= BUCKETS]), 6) for b, n in enumerate(own)])
    return priors, logs


def with_evidence(docs: DataFrame, priors: list[float], logs: list[list[float]], text: str = "text", evidence: float | None = None) -> tuple[DataFrame, str]:
    """Add a struct column: n_tokens (words), and logits, a number a domain.

    ``evidence`` bounds the features that a posterior rests on (longer texts' are scaled down to it); by default all count.
    """
    out, w, b = free_name(docs, "feat"), free_name(docs, "words"), free_name(docs, "buckets")
    # what all domains have in common says nothing; without it the sums stay small
    shared = [min(x) for x in zip(*logs, strict=True)]
    tables = [F.from_json(F.lit(json.dumps([round(x - y, 6) for x, y in zip(log, shared, strict=True)])), "array<double>") for log in logs]

    def total(table: Column) -> Column:
        return F.aggregate(F.col(b), F.lit(0.0), lambda a, i: a + F.get(table, i))

    n = F.size(b).cast("double")
    scale = F.lit(1.0) if evidence is None else F.least(n, F.lit(float(evidence))) / F.greatest(n, F.lit(1.0))
    logits = F.array(*[F.lit(p) + total(t) * scale for p, t in zip(priors, tables, strict=True)])
    split = docs.withColumn(w, words(F.col(text))).withColumn(b, buckets(F.col(w)))
    return split.withColumn(out, F.struct(F.size(w).cast("long").alias("n_tokens"), logits.alias("logits"))).drop(w, b), out


def posterior(logits: Column) -> Column:
    """Shares that add up to one."""
    top = F.array_max(logits)
    shares = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shares, lambda x: x / total)


def unbound(share: Column, lean: list[float]) -> Column:
    free = F.lit(1.0)
    for i, x in enumerate(lean):
        free = free + F.get(share, F.lit(i)) * F.lit(float(x))
    return free


def rate(share: Column, lean: list[float], most: float = MAX_RATE) -> Column:
    """The rate of a document of posterior ``share``."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), unbound(share, lean)))


def _look(docs: DataFrame, targets: np.ndarray, lean: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Relative errors at ``lean``, overlaps of domains a target, and the convex function that steps lessen."""
    k, share, u, r = len(targets), F.col("share"), F.col("u"), F.col("r")
    rows = docs.select("share", "tokens", unbound(share, lean.tolist()).alias("u")).withColumn("r", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), u)))
    moved = F.when((u > 0) & (u < most), F.col("tokens")).otherwise(0.0)
    each = rows.select("share", (F.col("tokens") * r).alias("w"), moved.alias("a"), (F.col("tokens") * (r * u - r * r / 2)).alias("d"), F.posexplode("share").alias("j", "p"))
    overlaps = [F.sum(F.col("a") * F.col("p") * F.get(share, F.lit(i))).alias(f"o{i}") for i in range(k)]
    total, overlap, value = np.zeros(k), np.zeros((k, k)), 0.0
    for row in each.groupBy("j").agg(F.sum(F.col("w") * F.col("p")).alias("s"), F.sum(F.col("d") * F.col("p")).alias("d"), *overlaps).collect():
        total[row["j"]], overlap[row["j"]] = row["s"], row[3:]
        value += row["d"]
    wanted = np.where(targets > 0, targets, np.inf)  # a domain without a target asks for nothing
    return np.where(targets > 0, (total - targets) / wanted, 0.0), overlap / wanted[:, None], value - targets @ lean + PULL / 2 * targets @ lean**2


def fit_rates(docs: DataFrame, targets: list[float], most: float = MAX_RATE, steps: int = STEPS) -> list[float]:
    """The lean of each domain; ``docs`` (tokens, share) is read once a step, targets are token totals a domain."""
    wanted = np.array(targets, float)
    lean, slack = np.zeros(len(wanted)), (DAMP + PULL) * np.eye(len(wanted))
    error, overlap, value = _look(docs, wanted, lean, most)
    whole = overlap
    for _ in range(steps):
        if np.abs(error).max(initial=0.0) <= CLOSE:
            break
        new = lean - np.linalg.solve(overlap + slack, error + PULL * lean)
        found = _look(docs, wanted, new, most)
        if found[2] > value and overlap is not whole:
            overlap = whole
            continue
        before, lean, (error, overlap, value) = error, new, found
        if np.abs(error - before).max() <= STILL:
            break
    return lean.tolist()


def with_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, most: float = MAX_RATE, evidence: float | None = None, learn_from: int = MAX_LABELLED) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_tokens, posterior, rate, copies), and its name.

    Targets are shares of all tokens; ``most`` bounds rates, which may then miss them. The rows are written once with their evidence
    (without the text unless ``keep_text``); that table serves the steps and the output.
    """
    targets = targets or TARGETS
    domains = list(targets)
    priors, logs = learn(docs, labelled, domains, doc_id, text, learn_from)
    featured, feat = with_evidence(docs, priors, logs, text, evidence)
    f = F.col(feat)
    featured = featured.withColumn(feat, F.struct(f["n_tokens"].alias("n_tokens"), posterior(f["logits"]).alias("posterior")))
    featured = materialise(featured if keep_text else featured.drop(text), "mix-features")
    weights = featured.select(f["n_tokens"].alias("tokens"), f["posterior"].alias("share"))
    total, weight = weights.agg(F.sum("tokens")).first()[0] or 0, sum(targets.values())
    found = rate(f["posterior"], fit_rates(weights, [total * w / weight for w in targets.values()], most), most)
    part = (F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(0))), F.lit(1_000_003)) + 0.5) / 1_000_003
    copies = F.floor(found) + (part < found - F.floor(found)).cast("long")
    return featured.withColumn(feat, F.struct(f["n_tokens"].alias("n_tokens"), f["posterior"].alias("posterior"), found.alias("rate"), copies.alias("copies"))), feat


def totals(mixed: DataFrame, found: str, targets: dict[str, float] | None = None) -> DataFrame:
    """(domain, wanted, reached): token totals asked for, and those that the rates give."""
    targets = targets or TARGETS
    weight = sum(targets.values())
    f = F.col(found)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, targets)).alias("domain"), F.array(*[F.lit(w / weight) for w in targets.values()]).alias("w"), f["posterior"].alias("p")))
    rows = mixed.select(f["n_tokens"].alias("n"), f["rate"].alias("rate"), each.alias("x"))
    return rows.groupBy("x.domain").agg((F.first("x.w") * F.sum("n")).alias("wanted"), F.sum(F.col("n") * F.col("rate") * F.col("x.p")).alias("reached"))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): languages of the documents that the labelled table calls good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return docs.where("lang is not null").select("doc_id", "lang").join(good, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
