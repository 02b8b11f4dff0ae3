"""Each stage of the pipeline against a plain version, on what its predecessor kept."""

import math
from collections import Counter

import corpus_pipeline
import edge
import numpy as np
import pytest
from xxhash import xxh64_intdigest
from test_dedup import roots
from test_mixing_targets import plain_rates
from test_rules_and_classifier import plain_measures

from quartermark.llm import bpe, classifier, mixing, near_copies, quality_rules
from quartermark.llm.common import materialise
from quartermark.llm.queries import rank_path, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_but_the_last_stage_return_documents(outputs):
    for df in outputs[:-1]:
        assert df.columns == outputs[0].columns and df.dtypes == outputs[0].dtypes
    assert all(df.count() > 0 for df in outputs)


def test_classifier_stage(spark, outputs):
    w, hasher = classifier.train(outputs[0], table(spark, SF, "labels")), classifier.Hasher()

    def score(text):
        found = hasher.buckets(text or "")
        return 1 / (1 + math.exp(-(w[found].sum() * classifier.SCALE / len(found) + w[-1] if len(found) else w[-1])))

    assert rows(outputs[1]) == Counter({k: n for k, n in rows(outputs[0]).items() if score(k[1]) >= 0.7})


def plain_verdict(text):
    n, chars, symbols, dup, repeat = plain_measures(text)
    lines = sum(1 for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r"))
    upper = sum(any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or ""))
    return n < 20 or 100 * repeat > 30 * n or symbols > 0.1 * n or (dup >= 3 and dup > 0.3 * lines) or upper > 0.5 * n or chars > 20 * n


def test_rules_stage(outputs):
    before = rows(outputs[1])
    n, f = Counter(), Counter()
    for k, c in before.items():
        n[k[3]] += c
        f[k[3]] += c * plain_verdict(k[1])
    a, b = quality_rules.fit_beta(sum(n.values()), sum(f.values()), len(n), sum(f[h] ** 2 / n[h] for h in n))
    bad = {h for h in n if (f[h] + a) / (n[h] + a + b) > 0.5}
    assert rows(outputs[2]) == Counter({k: c for k, c in before.items() if not plain_verdict(k[1]) and k[3] not in bad})


def test_dedup_stage(outputs):
    """One of each group whose texts share 0.8 of their five-word shingles, by all pairs."""
    before = outputs[2].collect()
    sets = {r["doc_id"]: set(near_copies.shingles(r["text"]).tolist()) for r in before}
    ids = sorted(sets)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert alike and sorted(r["doc_id"] for r in outputs[3].collect()) == sorted(set(roots(ids, alike).values()))
    assert set(rows(outputs[3])) <= set(rows(outputs[2]))


def test_mixing_stage(spark, outputs):
    before = outputs[3]
    labelled = mixing.labelled_domains(before, table(spark, SF, "labels"))
    got = before.collect()
    counts, n_rows = {d: Counter() for d in mixing.TARGETS}, Counter()
    texts = {r["doc_id"]: r["text"] for r in got}
    for r in labelled.collect():
        counts[r["domain"]].update(plain_buckets(texts[r["doc_id"]]))
        n_rows[r["domain"]] += 1
    share, t, ids = [], [], []
    for r in got:
        found = plain_buckets(r["text"])
        logit = []
        for d, c in counts.items():
            mass = [mixing.BUCKETS + sum(n for b, n in c.items() if (b >= mixing.BUCKETS) == late) for late in (False, True)]
            logit.append(math.log((n_rows[d] + 1) / (sum(n_rows.values()) + 4)) + sum(math.log((c[b] + 1) / mass[b >= mixing.BUCKETS]) for b in found))
        e = np.exp(np.array(logit) - max(logit))
        share.append(e / e.sum())
        t.append(len(found) // 2)
        ids.append(r["doc_id"])
    share, t = np.array(share), np.array(t, float)
    mixed, f = mixing.with_rates(before, labelled)
    said = {r["doc_id"]: r[f] for r in mixed.collect()}
    assert all(np.allclose(said[i]["posterior"], s, atol=1e-3) and said[i]["n_tokens"] == n for i, s, n in zip(ids, share, t, strict=True))
    share = np.array([said[i]["posterior"] for i in ids])
    targets = t.sum() * np.array(list(mixing.TARGETS.values())) / sum(mixing.TARGETS.values())
    rates, _ = plain_rates(share, t, targets)
    assert all(abs(said[i]["rate"] - x) < 1e-6 * max(1, x) for i, x in zip(ids, rates, strict=True))
    for r in mixing.totals(mixed, f).collect():
        i = list(mixing.TARGETS).index(r["domain"])
        assert abs(r["wanted"] - targets[i]) < 1e-6 * targets[i] and abs(r["reached"] / targets[i] - 1) < 0.01
    from pyspark.sql import functions as F

    u = {r[0]: r[1] for r in before.select("doc_id", ((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) + 0.5) / 1_000_003)).collect()}
    want = Counter({i: int(said[i]["rate"]) + (u[i] < said[i]["rate"] - int(said[i]["rate"])) for i in ids})
    assert +want == Counter(r["doc_id"] for r in outputs[4].collect())


def plain_buckets(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", lowered)
    signed = lambda w: (lambda h: h - (1 << 64) if h >> 63 else h)(xxh64_intdigest(w.encode(), 42))
    return [signed(w) % mixing.BUCKETS for w in words] + [mixing.BUCKETS + signed(w[-3:]) % mixing.BUCKETS for w in words]


def test_last_stage(outputs):
    texts = {r["doc_id"]: r["text"] for r in outputs[4].collect()}
    got = outputs[5].collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in outputs[4].collect())
    assert all(r["token_ids"] == bpe.encode(texts[r["doc_id"]], rank_path()) and r["n_tokens"] == len(r["token_ids"]) for r in got)


def test_stages_take_awkward_rows_and_empty_tables(spark):
    docs = edge.documents(spark)
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= mixing.MAX_RATE * df.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
