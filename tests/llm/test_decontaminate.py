import hashlib
import random
import re
import string
from collections import Counter

import edge
import pytest
from conftest import SF
from oracle import check, connection

from quartermark.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(texts, items, size=10):
    """(n_words, hit words, items) of each text."""
    grams = {}
    for item, text in items:
        w = words(text)
        for g in [w[i: i + size] for i in range(len(w) - size + 1)] if len(w) >= size else [w] if w else []:
            grams.setdefault(tuple(g), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i: i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[tuple(w[i: i + k])]
        out.append((len(w), hit, sorted(str(x) for x in found if x is not None)))
    return out


def tables(spark):
    rng = random.Random(3)
    vocabulary = ["Aa", "bb", "cc", "DD", "é1", "f2", "日本", "x"]
    items = [(f"i{i}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [("i0", "an item of one id with another text, which is longer than ten words are"), ("none", None), ("empty", " .,- "), (None, "an item without id but with more than ten words in it, all told"), ("same", items[3][1]), ("i20", "x")]
    texts = edge.texts(n=15)[:-1]
    for i in range(40):
        body = rng.choices(vocabulary + ["filler", "more"], k=rng.randint(0, 60))
        _, passage = items[i % len(items)]
        cut = (passage or "").upper() if i % 3 else " ".join((passage or "").split(" ")[:-1])
        at = rng.randint(0, len(body))
        texts.append(", ".join(body[:at]) + " - " + cut + "; " + " ".join(body[at:]))
    texts += [passage for _, passage in items]
    return edge.documents(spark, texts), spark.createDataFrame([(*x, "lang") for x in items], "item_id string, text string, doc_id string")


@pytest.mark.parametrize("broadcast", [1, 1 << 20])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    docs, benchmark = tables(spark)
    found, f = decontaminate.find(docs, benchmark)
    assert found.columns == [*docs.columns, f]
    rows, items = found.collect(), [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert len(rows) == docs.count() and sum(r[f]["n_hit"] > 0 for r in rows) > 20
    for r, (n, hit, ids) in zip(rows, plain([r["text"] for r in rows], items), strict=True):
        assert (r[f]["n_words"], r[f]["n_hit"], r[f]["items"]) == (n, len(hit), ids)
        assert {i - 1 for s in r[f]["spans"] for i in range(s["start"], s["end"])} == hit


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    docs, benchmark = tables(spark)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    found, f = decontaminate.find(docs, benchmark)
    rows = found.collect()
    for r, (n, hit, ids) in zip(rows, plain([r["text"] for r in rows], [(r["item_id"], r["text"]) for r in benchmark.collect()]), strict=True):
        assert (r[f]["n_words"], r[f]["n_hit"], r[f]["items"]) == (n, len(hit), ids)


def test_removal(spark):
    docs, benchmark = tables(spark)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    rows = docs.collect()
    wanted = plain([r["text"] for r in rows], items)
    clean = decontaminate.remove_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert Counter(clean.collect()) == Counter(r for r, (_, hit, _) in zip(rows, wanted, strict=True) if not hit)
    cut = decontaminate.remove_spans(docs, benchmark)
    assert cut.columns == docs.columns

    def left(text, hit):
        pieces = [m[0] for m in re.finditer(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        tail = text[sum(map(len, pieces)):]
        return "".join(p for i, p in enumerate(pieces) if i not in hit) + tail

    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter((r["doc_id"], left(r["text"], hit) if hit else r["text"]) for r, (_, hit, _) in zip(rows, wanted, strict=True))


def test_empty_tables(spark):
    docs, benchmark = tables(spark)
    found, f = decontaminate.find(docs, benchmark.limit(0))
    assert {r[f]["n_hit"] for r in found.collect()} == {0}
    assert decontaminate.find(docs.limit(0), benchmark)[0].count() == 0
    assert decontaminate.remove_spans(docs.limit(0), benchmark.limit(0)).count() == 0


def test_query(spark):
    df = queries.op12_decontamination(spark, SF)
    assert check(df, queries.OP12_SQL, connection(SF)) == 200
    assert sum(r["contaminated"] for r in df.collect()) > 0
    assert {r["items_sha256"] for r in df.collect() if not r["n_items"]} == {hashlib.sha256(b"").hexdigest()}


def test_no_python_on_the_way(spark):
    plan = queries.op12_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
