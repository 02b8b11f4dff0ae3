"""The pipeline's near copies against exact similarity of all pairs."""

import random

import corpus_pipeline
import pytest

from quartermark.llm import near_copies, simhash


def jaccard(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowd, rounds", [(128, 4), (6, 4), (6, 0), (2, 1)])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch, crowd, rounds):
    monkeypatch.setattr(near_copies, "CROWD", crowd)  # the small ones cut every bucket into parts
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(200)]
        texts.append(base)
        for changed in (1, 3, 4, 6, 9):
            copy = list(base)
            for i in rng.sample(range(200), changed):
                copy[i] = rng.choice(words)
            texts.append(copy)
    chain = [rng.choice(words) for _ in range(100)]  # neighbours are alike, the ends aren't
    for i in range(40):
        texts.append(list(chain))
        chain[(i * 7) % 100] = rng.choice(words)
    shared = [rng.choice(words) for _ in range(100)]  # half of a text that many texts share, which alone makes no copies
    texts += [shared + [rng.choice(words) for _ in range(60)] for _ in range(30)]
    texts = [" ".join(t) for t in texts]
    group = list(range(len(texts)))
    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= near_copies.LEAST:
                wide += ((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])) % (1 << 64)).bit_count() > 2
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert wide > 0  # pairs that two bits can't see
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))


def test_a_group_of_one_key_is_settled_in_bounded_parts(spark, monkeypatch):
    """Texts that are all near copies of one: every task gets a part, and one text stays."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for i in rng.sample(range(150), 2):
            copy[i] = f"x{rng.randrange(500)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(near_copies, "CROWD", 20)
    largest = spark.sparkContext.accumulator(0)
    real = near_copies._verify

    def verify(rows):
        largest.add(rows.num_rows > 80)
        return real(rows)

    monkeypatch.setattr(near_copies, "_verify", verify)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [r["doc_id"] for r in near_copies.keep_one(docs).collect()] == [0]
    assert largest.value == 0


def test_rows_come_back_whole_by_file_and_by_join(spark):
    """Columns of any type survive; ``array`` columns take the join, the others the part files."""
    from pyspark.sql import functions as F

    rows = [(i, None if i % 5 == 0 else f"a b c d e f{i % 3} g{i % 3}", i % 2 == 0, i / 3, None if i % 2 else "x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` boolean, node double, file string").withColumn("day", F.date_add(F.lit("2024-01-01"), F.col("doc_id").cast("int"))).repartition(4)
    kept = near_copies.keep_one(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    wanted = sorted(docs.where("doc_id in (0, 1, 2, 3)").collect())
    assert sorted(kept.collect()) == wanted
    nested = near_copies.keep_one(docs.withColumn("tags", F.array("doc_id")))
    assert sorted(nested.drop("tags").collect()) == wanted
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_fingerprints_bring_copies_together_where_no_band_does(spark):
    """With a key of its own for each text in every band, SimHash still links copies within two bits, and only true ones."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], "tail"])]
    tails = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(2)]
    texts += ["a b c d e " * 50 + t for t in tails]  # one fingerprint, few shingles in common
    prints = [simhash.fingerprint(t, near_copies.SHINGLE) for t in texts]
    assert prints[-1] == prints[-2] and jaccard(*texts[-2:]) < near_copies.LEAST
    close = {(i, i + 1) for i in range(0, 120, 2) if ((prints[i] ^ prints[i + 1]) % (1 << 64)).bit_count() <= simhash.MAX_BITS}
    assert len(close) > 20
    signed = [near_copies.signature(t).tolist() for t in texts]
    assert [s[1] for s in signed] == prints and all(len(s) == 2 + near_copies.BANDS for s in signed)
    marked = spark.createDataFrame([(i, p, [i]) for i, p in enumerate(prints)], "node long, fp long, bands array<long>")
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = near_copies.links(marked, lambda nodes: held.join(nodes, "node", "left_semi"))
    assert {tuple(sorted(r)) for r in found.collect()} == close
