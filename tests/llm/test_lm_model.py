"""The language model's size and what it learns from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.llm import bpe, lm
from quartermark.llm.queries import rank_path


def test_tokens_past_the_first_window_have_eight_ids_of_context():
    assert lm.WINDOW - lm.STRIDE >= 8
    owner, start, first = lm.windows(np.array([400]))
    assert all(f >= 8 for f in first[1:])


def test_four_thousand_subwords_have_outputs_of_their_own():
    g = np.random.default_rng(3)
    ids = np.repeat(np.arange(4094), 2)
    model = lm.fit([g.permutation(ids)], epochs=1)
    assert (model.rank != lm.RARE).sum() >= 4094 and len(set(model.rank[:4094].tolist())) == 4094


def test_texts_outside_the_start_are_learnt(spark, monkeypatch):
    """With one text in the starting fit, the words of all other training texts still gain scores and outputs."""
    monkeypatch.setattr(lm, "TRAIN_DOCS", 1)
    monkeypatch.setattr(lm, "EPOCHS", 1)
    common, other = "the quick brown fox " * 40, "zebra violin quartz harbour " * 40
    rows = [(i, common if i == start_id(spark) else other) for i in range(40)] + [(100, "zebra violin quartz harbour " * 10), (101, "glacier tundra walrus pebble " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, rank_path(), F.col("doc_id") >= 100).collect()}
    n = len(bpe.encode(" zebra violin quartz harbour" * 10, rank_path())) + 1
    assert got[100] / n > -1.0 > got[101] / n


def start_id(spark):
    return spark.range(40).select("id").orderBy(F.xxhash64("id"), "id").first()["id"]


def test_a_text_beyond_the_start_is_cut_and_not_left_out(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(lm, "TRAIN_TOKENS", 50)
    taken = []
    monkeypatch.setattr(lm, "fit", lambda sequences, **_: taken.extend(sequences) or lm.Attention.even())
    counts = type("Held", (), {"value": np.ones(lm.VOCABULARY, dtype=np.int64)})
    list(lm._train(rank_path(), counts, 1)(iter([pd.DataFrame({"text": ["word " * 200, "more " * 5]})])))
    assert sum(map(len, taken)) == 50


def windows_of(model, n=40, seed=5):
    g = np.random.default_rng(seed)
    owner, ids, target, used = next(model.batches([g.integers(1, 4096, g.integers(0, 200)) for _ in range(n)]))
    assert used[:, 0].any() and not used[:, 0].all()
    return ids, target, used


@pytest.mark.parametrize("times", [1, 8])  # of which the greater needs shifts before exp
def test_used_positions_alone_give_the_states_and_losses_of_the_plain_model(times):
    model = lm.Attention.fresh(np.arange(lm.VOCABULARY).clip(0, lm.RARE))
    model.p = {k: v * np.float32(times if k in "EUC" else 1) for k, v in model.p.items()}
    ids, target, used = windows_of(model)
    plain = model.hidden(ids)[0][used]
    states = model.states(ids, used)
    assert np.allclose(states, plain, rtol=1e-3, atol=1e-3)
    logp = model.output(plain, target[used])[0]
    assert np.allclose(model.log_probabilities(states, target[used]), logp, rtol=1e-4, atol=1e-3)
    assert np.isclose(model.gradient(ids, target, used)[0], -logp.mean(), rtol=1e-4)


def test_context_of_later_windows_takes_no_queries(monkeypatch):
    """The first eight ids of a later window are keys and values only, in scoring and in learning."""
    model = lm.Attention.fresh(np.arange(lm.VOCABULARY).clip(0, lm.RARE))
    ids, target, used = windows_of(model)
    first, rows = int(used[:, 0].sum()), []
    attend = lm.Attention.attend
    monkeypatch.setattr(lm.Attention, "attend", lambda *a: rows.append(attend(*a)) or rows[-1])
    for run in (lambda: model.states(ids, used), lambda: model.gradient(ids, target, used)):
        rows.clear()
        run()
        assert sum(a.shape[0] * a.shape[1] for a, _ in rows) == lm.STRIDE * len(ids) + (lm.WINDOW - lm.STRIDE) * first


def test_fit_takes_the_steps_of_adam():
    g = np.random.default_rng(4)
    sequences = [g.integers(0, 300, g.integers(1, 90)) for _ in range(40)]
    start = lm.from_counts(np.bincount(np.concatenate(sequences), minlength=lm.VOCABULARY), 40)
    model = lm.Attention({k: v.copy() for k, v in start.p.items()}, start.rank)
    ids, target, used = (np.concatenate(x) for x in list(zip(*model.batches([model.rank[s] for s in sequences]), strict=True))[1:])
    m, s = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    shuffled, steps = np.random.default_rng(11).permutation(len(ids)), -(-len(ids) // 16)
    for t in range(1, steps + 1):
        pick = shuffled[(t - 1) * 16: t * 16]
        for k, d in model.gradient(ids[pick], target[pick], used[pick])[1].items():
            m[k] += 0.1 * (d - m[k])
            s[k] += 0.01 * (d * d - s[k])
            model.p[k] -= (0.01 * (1 - 0.9 * t / steps) / (1 - 0.9**t) * m[k] / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    got = lm.fit(sequences, 1, 16, model=lm.Attention({k: v.copy() for k, v in start.p.items()}, start.rank))
    for k, v in model.p.items():
        assert np.allclose(got.p[k], v, atol=2e-3), k
