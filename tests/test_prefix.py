"""Longest prefixes: one reading for all quotes that begin with a word, and the same as trying every prefix."""

from pyspark.sql import functions as F

from quartermark.operators import compare

TEXTS = ["the cat  sat on the mat", "bathe cat sat on", " lead the\ncat", "x the cats", "foo bar  baz qux", "", "é§ été", "foo bar", "the"]
QUOTES = ["the cat sat on the roof", "the cat  sat on a", "the catamaran sails far", "the§", "he", "zebra", "foo bar baz", "foo  bar", "foo bar  ", " the cat", "\nlead", "  ", "t", "été il y a", "bar  baz qux more", "at", "sat on"]


def test_as_by_trying_every_prefix(spark, monkeypatch):
    asked = []
    rounds = compare.contained
    monkeypatch.setattr(compare, "contained", lambda q, *a: (asked.extend(r[0] for r in q.select("__quote").collect()), rounds(q, *a))[1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[0]])], "doc_id long, text string")
    quotes = spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, quote string")
    got = {r["item_id"]: (r["prefix"], r["doc_id"]) for r in compare.longest_prefix(quotes, "quote", docs, "text", "item_id", "doc_id").collect()}
    for i, q in enumerate(QUOTES):
        n = max(k for k in range(len(q) + 1) if k == 0 or any(q[:k] in t for t in TEXTS))
        assert got[i] == (n, next(d for d, t in enumerate(TEXTS) if q[:n] in t) if n else None), q
    assert all(a[0].isspace() for a in asked)  # the rest takes no rounds over the texts
    assert docs.select(F.count("*")).first()[0] == len(TEXTS) + 2
