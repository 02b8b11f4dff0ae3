import random
import re
import string
from collections import Counter

import edge
import numpy as np
import pytest
from conftest import SF
from oracle import check, connection

from quartermark.llm import queries, source_audit

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for *_, terms in own for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= 3)
        sources = sorted({d[1] for d in own})
        counts = {s: Counter(t for _, x, terms in own if x == s for t in terms if held[t] >= 3) for s in sources}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023

        for s in sources:
            pairs = [(-sum((p(counts[s], t) - p(counts[o], t)) ** 2 // p(counts[o], t) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p(counts[s], t) - p(whole, t)) ** 2 // p(whole, t)), t.encode()) for t in kept if counts[s][t] and p(counts[s], t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found))}
    return out


def rows_of(docs):
    return [(r["lang"], r["source"], r["text"]) for r in docs.select("lang", "source", "text").collect()]


def found(docs):
    rows = [tuple(r) for r in source_audit.audit(docs).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_awkward_documents(spark):
    docs = edge.documents(spark, edge.texts() + [" ".join(f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400))] * 15 + ["other words here " * 90] * 11)
    got = found(docs)
    assert got == plain(rows_of(docs))
    assert {part for _, _, part, *_ in got} == {"pair", "term"} and max(r[-1] for r in got) == 200


@pytest.mark.parametrize("small", [{"BLOCK": 2, "CELLS": 5}, {"BROADCAST": 0, "RANGE_ROWS": 50}])
def test_sizes_do_not_matter(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(source_audit, name, value)
    docs = edge.documents(spark)
    assert found(docs) == plain(rows_of(docs))


def test_tries_hand_on_and_merge(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "LEAVES", 5)
    monkeypatch.setattr(source_audit, "BLOCK_WORDS", 20)
    monkeypatch.setattr(source_audit, "CHUNK", 3)
    monkeypatch.setattr(source_audit, "BURST", 2)
    rng = random.Random(2)
    texts = [("en" if i % 3 else "fr", f"s{i % 4}", " ".join(rng.choices(["a", "ab", "abc", "Abd", "é", "èa", "zz", "日本"], k=rng.randint(0, 9))).encode()) for i in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], names=["lang", "source", "text"])
    rows = pa.Table.from_batches(source_audit.count_terms([batch])).sort_by([("lang", "ascending"), ("term", "ascending")])
    want = Counter((lang, t.decode(), s) for lang, s, x in texts for t in source_audit.TERM.findall(x.lower()))
    got = Counter()
    for r in rows.to_pylist():
        got.update({(r["lang"], r["term"], s): n for s, n in zip(r["source"], r["count"], strict=True) if r["term"]})
    assert got == want
    merged = Counter()
    for chunk in source_audit.merge_ranges(rows.filter(pa.compute.not_equal(rows["term"], "")).to_batches(max_chunksize=7)):
        row = chunk.to_pylist()[0]
        at = 0
        assert row["term"] == sorted(row["term"], key=str.encode)
        for term, size in zip(row["term"], row["size"], strict=True):
            for k in range(at, at + size):
                merged[row["lang"], term, row["source"][k]] += row["count"][k]
            at += size
    docs = Counter((lang, t) for lang, _, x in texts for t in set(source_audit.TERM.findall(x.lower())))
    assert merged == Counter({k: n for k, n in want.items() if docs[k[0], k[1].encode()] >= 3})


@pytest.mark.parametrize("burst", [1, 7, 4096])
def test_merged_tries_walk_in_byte_order(monkeypatch, burst):
    monkeypatch.setattr(source_audit, "BURST", burst)
    a, b = source_audit.Trie(), source_audit.Trie()
    rng = random.Random(4)
    want = Counter()
    for i in range(500):
        term = "".join(rng.choices("abé日", k=rng.randint(1, 6))).encode()
        (a if i % 2 else b).add(term, 1, [i % 3, i])
        want[term, i % 3] += i
    a.merge(b)
    walked = list(a.walk())
    got = Counter({(t, x[k]): x[k + 1] for t, x in walked for k in range(1, len(x), 2)})
    assert [t for t, _ in walked] == sorted({t for t, _ in want}) and got == want and sum(x[0] for _, x in walked) == 500 and a.counters == len(want)


def test_whole_numbers_beyond_64_bits():
    counts, totals = [0, 10**13, 5 * 10**14], [10**15, 10**15 + 7, 10**15 + 9]
    assert source_audit.scaled(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


def test_no_terms_and_no_rows(spark):
    docs = edge.documents(spark, ["1 2", "", None, "one two"])
    assert found(docs) == plain(rows_of(docs))
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_query(spark):
    assert check(queries.op13_source_divergence(spark, SF), queries.OP13_SQL, connection(SF)) > 5000
