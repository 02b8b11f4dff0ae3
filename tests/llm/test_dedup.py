import random

import edge
import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quartermark.llm import embedding_dedup, simhash
from quartermark.llm.components import connected_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    df = spark.createDataFrame([*links, *links[:20], (None, 1), (1, None)], "a long, b long").repartition(7)
    nodes = {x for e in links for x in e if e[0] != e[1]}
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = roots(nodes, [e for e in links if e[0] != e[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_print(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i: i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_against_the_definition():
    for t in edge.texts()[:-1]:
        assert simhash.fingerprint(t) % (1 << 64) == plain_print(t)


def test_spark_hash_is_the_same(spark):
    words = ["a b c", "é ß 日本", "x" * 100]
    from pyspark.sql import functions as F

    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(w,) for w in words], "s string").select(F.xxhash64("s")).collect()]
    assert got == [xxh64_intdigest(w.encode(), 42) for w in words]


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)
    assert (np.bincount(simhash.codeword(words), minlength=4096) == 2048).all()


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flips = (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    a, b = simhash.codeword_keys(words), simhash.codeword_keys(words ^ flips)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert {len(set(x)) for x in a.tolist()} == {1, 6}


def link_classes(prints):
    u = sorted(set(prints))
    return roots(u, [(a, b) for i, a in enumerate(u) for b in u[i + 1:] if ((a ^ b) % (1 << 64)).bit_count() <= 2])


@pytest.mark.parametrize("bucket", [32, 1])
def test_groups_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # 1: every shared bucket goes the way of crowded ones
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(6):  # clusters that need chains of links, and pairs at three bits
        base = rng.getrandbits(64)
        for _ in range(40):
            prints.append(base)
            base ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        prints.append(base ^ 0b10101)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in sorted(set(signed))], "fp long")
    got = {r["node"]: r["component"] for r in simhash.groups(df).collect()}
    want = link_classes(signed)
    sizes = {c: sum(x == c for x in want.values()) for c in want.values()}
    assert got == {p: c for p, c in want.items() if sizes[c] > 1}


def test_near_duplicates_against_brute_force(spark):
    docs = edge.documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    classes = link_classes(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        c, i = classes[p], r["doc_id"]
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((str(r["doc_id"]), p, least.get(classes[p])) for r, p in zip(rows, prints, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(classes.values()))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} <= set(least.values())


def test_empty_tables(spark):
    assert simhash.near_duplicates(edge.documents(spark).limit(0)).count() == 0
    assert simhash.keep_one(edge.documents(spark).limit(0)).count() == 0
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def vectors(seed=4, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(width)
        rows += [(base + s * rng.standard_normal(width)) * rng.uniform(0.1, 9) for s in (0, 0.05, 0.1, 0.15, 0.2)]
    rows += [rows[0], rows[0], rows[0] * 3, -rows[0], rng.standard_normal(width - 1)]
    out = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]
    odd = [None, [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), []]
    out += [(1000 + i, v) for i, v in enumerate(odd)] + [out[7], (None, out[3][1]), (7, [1.0] * width)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "TILE_MIN", 16)
    rows = vectors()
    whole = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if whole[i] and whole[j] and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links.append((i, j))
    group = roots(range(len(rows)), links)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[group[i]] = min(v, least.get(group[i], v))
    count = np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    want = sorted((str(v), int(count[i]), least.get(group[i])) for i, (v, _) in enumerate(rows))
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, n_links string").repartition(3)
    got = embedding_dedup.link_vectors(df).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_of_any_magnitude(spark):
    rows = [(1, [1e-200, 2e-200, 0.0]), (2, [1.0, 2.0, 0.0]), (3, [2.0, 4.0, 0.0]), (4, [1e300, 2e300, 1e299]), (5, [5e-324, 1e-323, 0.0]), (6, [0.0, 0.0, 1e-320]), (7, [0.0, 0.0, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(df).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (1, 6), 7: (1, 6)}


def test_many_tiles_with_a_large_group(spark, monkeypatch):
    """Clustered vectors over many tiles and strips, so that tiles are skipped, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "TILE_MIN", 8)
    monkeypatch.setattr(embedding_dedup, "TILE", 24)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((12, 20))
    x = np.concatenate([base[i % 12] + rng.uniform(0.02, 0.3) * rng.standard_normal((1, 20)) for i in range(500)] + [base[0] + 0.05 * rng.standard_normal((200, 20))]).astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    group = roots(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), group[i]) for i in range(len(x))}


def test_each_vector_is_shuffled_once_for_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_MIN", 16)
    seen = []
    real = embedding_dedup.materialise
    monkeypatch.setattr(embedding_dedup, "materialise", lambda df, label: seen.append((label, df)) or real(df, label))
    df = spark.createDataFrame([(i, v) for i, v in vectors() if v], "vec_id long, embedding array<double>")
    embedding_dedup.link_vectors(df).count()
    plans = {label: d._jdf.queryExecution().optimizedPlan().toString() for label, d in seen}
    assert "vector" not in plans["vector-links"].split("MapInArrow")[1].replace("vector-", "")


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64)) * np.exp(rng.standard_normal((300, 64)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, loss = embedding_dedup.quantise(x)
    rough = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None]
    bound = loss[:, None] + (1 + loss[:, None]) * loss[None]
    assert (np.abs(x @ x.T - rough) <= bound + 1e-12).all()
    assert (codes.astype(np.float32) @ codes.T.astype(np.float32) == codes.astype(np.int64) @ codes.T.astype(np.int64)).all()
