import hashlib
import math
import random
from collections import Counter

import edge
import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartermark.llm import bpe, lm, token_counts
from quartermark.llm.queries import rank_path


def plain_merge(piece, ranks):
    parts = [piece[i: i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def plain_ids(text):
    ranks = bpe.encoding(rank_path())._mergeable_ranks
    return [i for piece in regex.findall(public_tokenizers.PATTERN, text or "") for i in plain_merge(piece.encode(), ranks)]


def test_ids_are_those_of_each_match():
    for t in edge.texts()[:-1]:
        assert bpe.encode(t, rank_path()) == plain_ids(t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t\x0b\x1c  é日'!s", max_size=200), st.integers(1, 40))
def test_parts_encode_as_the_whole(text, size):
    pieces = list(bpe.parts(text, size))
    assert "".join(pieces) == text
    enc = bpe.encoding(rank_path())
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


SPACE = " \n\t\x85\u00a0\u2003\u3000"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab1!'é\x1c", max_size=4), st.text(alphabet=SPACE, max_size=12)), max_size=6))
def test_runs_of_white_space_encode_as_the_whole(pairs):
    text = "".join(a + b for a, b in pairs)
    enc = bpe.encoding(rank_path())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "RUN", 3)
        m.setattr(bpe, "SPACES", __import__("re").compile(bpe.SPACES.pattern.replace(str(1 << 14), "3")))
        assert "".join(p for p, _ in bpe.runs(text)) == text
        assert bpe.encode(text, rank_path()) == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["w" + " " * 1_000_000 + "w", "\n" * 1_000_000, "\u3000" * 700_000 + "a"])
def test_very_long_white_space(spark, text):
    ids = bpe.encode(text, rank_path())
    assert bpe.decode(ids, rank_path()).decode() == text
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.count_tokens(docs, rank_path()).first()["n_tokens"] == len(ids)
    coded, f = bpe.with_tokens(docs, rank_path())
    assert coded.first()[f]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert lm.word_ids([("a" + "\u00a0" * 700_000).encode()], rank_path())[1][0] > 1


def test_round_trip(spark):
    docs = edge.documents(spark)
    coded, f = bpe.with_tokens(docs, rank_path())
    assert coded.columns == [*docs.columns, f]
    for r in coded.collect():
        ids = bpe.encoding(rank_path()).encode_ordinary(r["text"] or "")
        assert r[f]["ids"] == ids and r[f]["n_tokens"] == len(ids)
        assert r[f]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r[f]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.with_tokens(docs.limit(0), rank_path())[0].count() == 0


def test_token_counts(spark, monkeypatch):
    docs = edge.documents(spark)
    want = Counter((r["doc_id"], len(bpe.encode(r["text"], rank_path()))) for r in docs.collect())
    for file_bytes, block in ((1 << 25, 1 << 22), (2000, 64), (100, 6), (1 << 25, 2)):
        if block == 2:
            docs, want = docs.where("length(text) < 300"), None
        monkeypatch.setattr(token_counts, "FILE_BYTES", file_bytes)
        monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
        folder_counts = count_with(docs, block)
        expected = Counter((r["doc_id"], len(bpe.encode(r["text"], rank_path()))) for r in docs.collect()) if want is None else want
        assert folder_counts == expected
    assert token_counts.count_tokens(docs.limit(0), rank_path()).count() == 0


def count_with(docs, block):
    from quartermark.llm.common import fresh_path

    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    order = token_counts.write_token_files(docs, folder, rank_path())
    files = order.groupBy("file").agg(F.max("bytes").alias("bytes"))
    counts = token_counts.scan_token_files(spark, files, folder, block_bytes=block)
    rows = order.join(counts, ["file", "ordinal"], "left")
    return Counter((r["doc_id"], r["n_tokens"]) for r in rows.collect())


@pytest.mark.parametrize("block", [2, 4, 10, 1000])
def test_scan_of_handmade_files(spark, tmp_path, block):
    end, rng = 9, random.Random(1)
    files, want = [], set()
    for name, tail in (("a", []), ("b", [1, 2, 3]), ("c", [])):
        lengths = [rng.randrange(6) for _ in range(20)] if name != "c" else []
        ids = [i for n in lengths for i in [*[5] * n, end]] + tail
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
        files.append((name, 2 * len(ids)))
        want |= {(name, i, n) for i, n in enumerate(lengths + ([len(tail)] if tail else []))}
    (tmp_path / "d").write_bytes(np.array([5] * 7, dtype="<u2").tobytes())
    files.append(("d", 14))
    want.add(("d", 0, 7))
    got = token_counts.scan_token_files(spark, spark.createDataFrame(files, "file string, bytes long"), str(tmp_path), end, block_bytes=block)
    assert {tuple(r) for r in got.collect()} == want


# --- language model ---------------------------------------------------------------------

def small_model(seed=0):
    g = np.random.default_rng(seed)
    sequences = [g.integers(0, 300, g.integers(0, 90)) for _ in range(60)]
    return lm.fit(sequences, epochs=1), sequences


def test_words_encode_together_as_alone(monkeypatch):
    monkeypatch.setattr(lm, "LINES", 3)
    words = ["the", "été,", "a\u00a0b", "'s", "x", "12", "\u00a0", "日本", "...", "it's", "a\x1cb", "|", "y\u3000", "z"]
    flat, sizes = lm.word_ids([w.encode() for w in words], rank_path())
    alone = [bpe.encoding(rank_path()).encode_ordinary(" " + w) for w in words]
    assert flat.tolist() == [i for x in alone for i in x] and sizes.tolist() == [len(x) for x in alone]
    assert [x.tolist() for x in lm.word_ids([], rank_path())] == [[], []]


def test_every_token_is_scored_once():
    sizes = np.arange(1, 200)
    owner, start, first = lm.windows(sizes)
    seen = Counter()
    for o, s, f in zip(owner, start, first, strict=True):
        for p in range(f, lm.WINDOW):
            if s + p < sizes[o]:
                seen[int(o), int(s + p)] += 1
    assert seen == Counter({(i, p): 1 for i, n in enumerate(sizes) for p in range(n)})


def test_batched_scores_against_one_token_at_a_time():
    model, sequences = small_model()
    got = model.score([model.rank[s] for s in sequences])
    for s, value in zip(sequences, got, strict=True):
        ids = [lm.END, *model.rank[s], lm.END]
        total = 0.0
        for t in range(1, len(ids)):
            at = t - 1  # the window that scores position at
            k = 0 if at < lm.WINDOW else 1 + (at - lm.WINDOW) // lm.STRIDE
            context = np.array(ids[k * lm.STRIDE: t])
            padded = np.zeros(lm.WINDOW, dtype=np.int64)
            padded[: len(context)] = context
            h, _ = model.hidden(padded[None])
            logp, _ = model.output(h[0, [len(context) - 1]], np.array([ids[t]]))
            total += float(logp[0]) - (model.rare if ids[t] == lm.RARE else 0.0)
        assert abs(total / lm.LOG10 - value) < 1e-3


def test_probabilities_sum_to_one():
    model, _ = small_model()
    h, _ = model.hidden(np.zeros((1, lm.WINDOW), dtype=np.int64))
    h = np.repeat(h[0, :1], lm.CLASSES * lm.CLASS, axis=0)
    assert abs(np.exp(model.log_probabilities(h, np.arange(len(h)))).sum() - 1) < 1e-3


def test_gradient_against_differences():
    model, sequences = small_model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.mask = model.mask.astype(np.float64)
    _, ids, target, used = next(model.batches([model.rank[s] for s in sequences[:3]]))
    loss, grad = model.gradient(ids, target, used)
    g = np.random.default_rng(0)
    for name in model.NAMES:
        flat, dflat = model.p[name].reshape(-1), grad[name].reshape(-1)
        for i in g.choice(np.flatnonzero(np.abs(dflat) > 1e-6), 3) if (np.abs(dflat) > 1e-6).any() else []:
            old = flat[i]
            flat[i] = old + 1e-5
            up, _ = model.gradient(ids, target, used)
            flat[i] = old - 1e-5
            down, _ = model.gradient(ids, target, used)
            flat[i] = old
            assert abs((up - down) / 2e-5 - dflat[i]) < 1e-4 + 1e-3 * abs(dflat[i])


def test_model_learns_and_survives_storage():
    cycle = np.array([104, 100, 103, 101, 102])
    sequences = [np.tile(np.roll(cycle, k), 12) for k in range(4)] * 20
    model = lm.fit(sequences, epochs=80)
    again = lm.Attention.load(model.dump())
    held = np.tile(np.roll(cycle, 4), 12)
    score = again.score([again.rank[held]])[0]
    assert score == model.score([model.rank[held]])[0]
    assert score > 0.5 * len(held) * math.log10(1 / 5)  # better than guessing among the five


def plain_base(rows):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    counts = Counter()
    for _, held, t in rows:
        if not held:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, held, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held, len(tokens), sum(counts[w] > 0 for w in tokens), n, base))
    return out


def test_base_scores_against_brute_force(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(lm, "CHUNK_WORDS", 500)
    docs = edge.documents(spark)
    rows = [(r["doc_id"], r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0, r["text"]) for r in docs.collect()]
    want = sorted(plain_base(rows), key=str)
    got = lm.score_documents(docs, rank_path()).collect()
    assert [tuple(x[:5]) for x in sorted(want, key=lambda x: (str(x[0]), x[2], x[5]))] == [tuple(r)[:5] for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))]
    assert np.allclose(sorted(x[5] for x in want), sorted(r["base_score"] for r in got), rtol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(docs.limit(0), rank_path()).count() == 0
