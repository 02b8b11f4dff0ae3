"""Scarce domains reach their targets, whatever rates that takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.llm import mixing


def weighed(spark, shares, tokens):
    rows = [([float(x) for x in s], int(t)) for s, t in zip(shares, tokens, strict=True)]
    return spark.createDataFrame(rows, "share array<double>, tokens long").repartition(3)


def plain_rates(share, tokens, targets, most=mixing.MAX_RATE):
    """Rates and relative errors by scaled steps over all documents at once, each with a rate of its own."""
    slack = (mixing.DAMP + mixing.PULL) * np.eye(len(targets))

    def look(lean):
        u = 1 + share @ lean
        r = np.clip(u, 0, most)
        gram = (share * (tokens * ((u > 0) & (u < most)))[:, None]).T @ share / targets[:, None]
        return r, ((tokens * r) @ share - targets) / targets, gram, tokens @ (r * u - r * r / 2) - targets @ lean + mixing.PULL / 2 * targets @ lean**2

    lean = np.zeros(len(targets))
    rates, error, gram, value = look(lean)
    whole = gram
    for _ in range(mixing.STEPS):
        if np.abs(error).max() <= mixing.CLOSE:
            break
        new = lean - np.linalg.solve(gram + slack, error + mixing.PULL * lean)
        found = look(new)
        if found[3] > value and gram is not whole:
            gram = whole
            continue
        before, lean, (rates, error, gram, value) = error, new, found
        if np.abs(error - before).max() <= mixing.STILL:
            break
    return rates, error


def test_scaled_steps_agree_with_plain_projected_gradient():
    """Small unscaled steps, each document's rate projected by itself, end at the same rates."""
    rng = np.random.default_rng(5)
    share, tokens = rng.dirichlet(np.full(3, 0.3), 50), rng.integers(1, 100, 50).astype(float)
    targets = tokens.sum() * np.array([0.5, 0.3, 0.2])
    rate = np.ones(50)
    for _ in range(20_000):
        rate = np.maximum(0, rate - 0.3 * (share @ (((rate * tokens) @ share - targets) / targets)))
    scaled, error = plain_rates(share, tokens, targets)
    assert np.abs(error).max() <= mixing.CLOSE and np.allclose(scaled, rate, atol=0.01)


def test_an_unreachable_target_moves_rates_little(spark):
    rng = np.random.default_rng(7)
    share = np.eye(4)[rng.integers(0, 3, 500)]
    share[:, 3] = 10 ** rng.uniform(-12, -3, 500)
    share /= share.sum(axis=1)[:, None]
    tokens = rng.integers(1, 1000, 500)
    targets = tokens.sum() * np.array([0.55, 0.17, 0.17, 0.11])
    docs = weighed(spark, share, tokens)
    got = [r[0] for r in docs.select(mixing.rate(F.col("share"), mixing.fit_rates(docs, targets.tolist()))).collect()]
    assert min(got) > 0.3 and max(got) < 3


@pytest.mark.parametrize("domains", [4, 40])
def test_every_document_has_the_rate_of_its_own_posterior(spark, domains):
    rng = np.random.default_rng(domains)
    share = rng.dirichlet(np.full(domains, 0.1), 600)
    share[1] = share[0] + np.where(np.arange(domains) == 0, 1e-4, 0) - np.where(np.arange(domains) == 1, 1e-4, 0)
    tokens = rng.integers(1, 1000, 600)
    targets = tokens.sum() * rng.dirichlet(np.full(domains, 5.0))
    docs = weighed(spark, share, tokens)
    lean = mixing.fit_rates(docs, targets.tolist())
    want, error = plain_rates(share, tokens.astype(float), targets)
    got = {tuple(r["share"]): r["rate"] for r in docs.withColumn("rate", mixing.rate(F.col("share"), lean)).collect()}
    assert len(got) == 600 and np.abs(error).max() <= mixing.CLOSE
    assert np.allclose([got[tuple(s)] for s in share.tolist()], want, atol=1e-7)
    assert got[tuple(share[0])] != got[tuple(share[1])] and min(got.values()) >= 0


def test_scarce_domains_meet_their_targets(spark):
    shares = (97, 1, 1, 1)
    g = 16
    p = np.array([[g if i == j else 0 for i in range(4)] for j in range(4)] + [[g - 1, 1, 0, 0], [1, 0, g - 1, 0]]) / g
    tokens = [round(s * 9_000) for s in shares] + [3_000, 500]
    targets = sum(tokens) * np.array(list(mixing.TARGETS.values()))
    docs = weighed(spark, p, tokens)
    got = docs.withColumn("rate", mixing.rate(F.col("share"), mixing.fit_rates(docs, targets.tolist()))).collect()
    totals = sum(r["rate"] * r["tokens"] * np.array(r["share"]) for r in got)
    assert np.abs(totals / targets - 1).max() < 0.005
    assert max(r["rate"] for r in got) > 8


def only_rate(docs, targets, **bound):
    return docs.withColumn("rate", mixing.rate(F.col("share"), mixing.fit_rates(docs, targets, **bound), **bound)).where("tokens > 0").first()["rate"]


def test_a_target_out_of_reach_ends(spark):
    assert only_rate(weighed(spark, [[1, 0]], [100]), [50.0, 50.0]) == pytest.approx(0.5, abs=0.01)


def test_rates_stay_under_the_bound_asked_for(spark):
    assert only_rate(weighed(spark, [[1, 0]], [100]), [900.0, 1.0], most=3.0) == 3.0


def test_any_labelled_domain_can_be_told_apart(spark):
    """Domains that no language marks: topics with words of their own, one of them only a small share of each text."""
    rng = np.random.default_rng(3)
    topics = {t: [f"{t}{i}" for i in range(80)] for t in ("law", "art", "sea")}
    rows = [(i, t, " ".join(rng.choice(topics[t], 40))) for i, t in enumerate(list(topics) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, topic string, text string").repartition(3)
    labelled = docs.where("doc_id < 90").select("doc_id", "topic")
    targets = {"law": 0.2, "art": 0.5, "sea": 0.3}
    mixed, f = mixing.with_rates(docs, labelled, targets)
    names = list(targets)
    assert all(names[int(np.argmax(r[f]["posterior"]))] == r["topic"] and abs(sum(r[f]["posterior"]) - 1) < 1e-9 for r in mixed.collect())
    got = {r["domain"]: r["reached"] / r["wanted"] for r in mixing.totals(mixed, f, targets).collect()}
    assert got.keys() == targets.keys() and all(abs(x - 1) < 0.005 for x in got.values())


def test_small_shares_count(spark):
    docs = weighed(spark, [[0.98, 0.02], [0.5, 0.5]], [1000, 0])
    assert only_rate(docs, [980.0, 40.0]) == pytest.approx(1 / 0.99, abs=1e-4)  # where 0.98 (r - 1) + 0.02 (r / 2 - 1) = 0; 1 if the small share were lost


def test_evidence_is_unbounded_unless_asked(spark):
    docs = spark.createDataFrame([(i, ("red " if i % 2 else "blue ") * 400) for i in range(20)], "doc_id long, text string")
    labelled = docs.selectExpr("doc_id", "if(doc_id % 2 = 1, 'r', 'b') as d")
    sure = [max(r[-1]["posterior"]) for r in mixing.with_rates(docs, labelled, {"r": 1.0, "b": 1.0})[0].collect()]
    weak = [max(r[-1]["posterior"]) for r in mixing.with_rates(docs, labelled, {"r": 1.0, "b": 1.0}, evidence=1)[0].collect()]
    assert min(sure) > 0.999999 and max(weak) < 0.9999
