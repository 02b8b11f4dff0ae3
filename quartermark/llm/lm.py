"""Language-model scores: a causal self-attention model over subword ids, in numpy.

The model has one attention head over a window of WINDOW ids; its output is factored into
64 classes of 64 ids by frequency, with one id that stands for all rarer ones (shared
evenly among them). Long sequences are cut into overlapping windows: each token is scored
once, in the first window in which at least WINDOW - STRIDE ids stand before it (or its
sequence begins). Windows are run in batches with one causal mask. A text is its words in
lower case (A-Z), each encoded with a space before it, and an end id.

Beside it goes a unigram base with add-0.1 smoothing over the words of all training texts.
Texts are cut into chunks of words once. A word comes at most once from a chunk; its counts
are added up by its 64-bit hash within groups of SALTED chunks, then over the groups, and go
back to the chunks by hash and group, so no key has more rows than a group has chunks or
than there are groups. Two words that share a 64-bit hash would be counted as one.

The attention model learns from all training texts. The subword ids counted over all of them
give its vocabulary and first output biases. A fit on at most TRAIN_DOCS texts and TRAIN_TOKENS
ids of them (those with the least hash of the id) is only where it starts: from there every
chunk's training texts are passed through once, each chunk by itself, and the model is the
mean of the chunks' parameters weighted by their ids. Chunks follow the splits of the input,
so scores hang on these a little. Defined results: a
null or empty text is its end token; repeated rows are counted and scored one by one; a
null id is held out (its remainder counts as 0); an empty table gives an empty result, and
without training rows the counts are zero and the model is even over ids.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode, encoding
from .common import fresh_path, materialise, open_filesystem, prepare, remainder, words_of_bytes

CHUNK_WORDS = 1 << 20
#: Chunks of a group in which a word's counts are added up first.
SALTED = 256
#: Documents of a chunk that are scored at a time.
DOCS = 64
#: Bits of a chunk's number within its partition, and of a word's index within its chunk.
LOCAL_BITS, WORD_BITS = 15, 26
TRAIN_DOCS, TRAIN_TOKENS, EPOCHS = 1500, 600_000, 6
#: Windows of a step, and its rate, when a chunk is passed through; rows that its sums are gathered in.
PASS_BATCH, PASS_RATE, GATHERED = 128, 0.003, 16
WIDTH, WINDOW, STRIDE = 16, 32, 24
CLASSES, CLASS = 64, 64
#: Words that are encoded in one call.
LINES = 4096
END, RARE = 0, CLASSES * CLASS - 1
#: Windows of a batch, those whose attention is computed at a time, and logits that exp takes as they are.
BATCH, INNER, SAFE = 1024, 64, 60.0
#: Rows of output logits computed at a time, and parameters changed at a time.
ROWS, STEP = 2048, 1 << 14
VOCABULARY = 50_257
LOG10 = float(np.log(10.0))


def windows(sizes: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, first scored position) of the windows of sequences with ``sizes`` targets."""
    n = 1 + np.maximum(0, -(-(sizes - window) // stride))
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return owner, k * stride, np.where(k == 0, 0, window - stride)


def by_class(target: np.ndarray) -> np.ndarray:
    """The order of model ids by their class."""
    return np.argsort((target // CLASS).astype(np.uint8), kind="stable")


def segments(target: np.ndarray) -> list[tuple[slice, slice]]:
    """(ids of a class, rows of its targets) for ``target`` in order of classes."""
    edges = np.searchsorted(target // CLASS, np.arange(CLASSES + 1)).tolist()
    return [(slice(g * CLASS, (g + 1) * CLASS), slice(a, b)) for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]


def with_ones(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows of ``h``, with a one at the end of each."""
    out = np.ones((len(rows), h.shape[1] + 1), dtype=h.dtype)
    out[:, :-1] = h.take(rows, axis=0)
    return out


def softmax(z: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax of each row of ``z`` at ``pick``, and the sum by which the row, now its exp, is to be divided."""
    if len(z) and max(float(z.max()), -float(z.min())) > SAFE:  # exp needs a shift only then
        z -= z.max(axis=1, keepdims=True)
    chosen = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + pick)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], dtype=np.float32)
    return chosen - np.log(total), total


def errors(z: np.ndarray, total: np.ndarray, pick: np.ndarray, n: int) -> None:
    """From exps to the gradient of the mean loss of ``n`` rows by their logits, in place."""
    z *= (1 / (n * total))[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + pick] -= np.float32(1 / n)


class Attention:
    """Parameters, loss gradient and scores of the model; ``rank`` maps subword ids to model ids."""

    NAMES = ("E", "P", "Q", "K", "V", "O", "C", "c", "U", "u")

    def __init__(self, params: dict[str, np.ndarray], rank: np.ndarray):
        self.p, self.rank = params, rank
        self.rare = float(np.log(max(1, int((rank == RARE).sum()))))
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, dtype=np.float32), 1)

    @classmethod
    def fresh(cls, rank: np.ndarray, seed: int = 7) -> Attention:
        g = np.random.default_rng(seed)
        n, d = CLASSES * CLASS, WIDTH
        shape = {"E": (n, d), "P": (WINDOW, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "C": (d, CLASSES), "c": (CLASSES,), "U": (n, d), "u": (n,)}
        scale = {"E": 0.3, "P": 0.1, "c": 0.0, "u": 0.0, "U": 0.1}
        return cls({k: (g.standard_normal(s) * scale.get(k, d**-0.5)).astype(np.float32) for k, s in shape.items()}, rank)

    @classmethod
    def even(cls) -> Attention:
        model = cls.fresh(np.full(VOCABULARY, RARE, dtype=np.int64))
        model.p = {k: np.zeros_like(v) for k, v in model.p.items()}
        return model

    def hidden(self, ids: np.ndarray):
        """(hidden states, weights) at all positions, as they are defined: what ``states`` and ``gradient`` are tested against."""
        p = self.p
        x = p["E"][ids] + p["P"]
        s = (x @ p["Q"]) @ (x @ p["K"]).transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + self.mask
        a = np.exp(s - s.max(axis=-1, keepdims=True))
        a /= a.sum(axis=-1, keepdims=True)
        return x + a @ (x @ p["V"]) @ p["O"], a

    def output(self, h: np.ndarray, target: np.ndarray):
        """(natural log probabilities of ``target`` given ``h``, logits of its class), as they are defined."""
        p, rows, group = self.p, np.arange(len(target)), target // CLASS
        z = h @ p["C"] + p["c"]
        y = np.einsum("nd,nkd->nk", h, p["U"].reshape(CLASSES, CLASS, -1)[group]) + p["u"].reshape(CLASSES, CLASS)[group]
        return sum(v[rows, at] - np.logaddexp.reduce(v, axis=1) for v, at in ((z, group), (y, target % CLASS))), z

    def blocks(self, used: np.ndarray):
        """(windows, rows, keys) whose attention is needed: rows that are only context for later ones go without queries."""
        context = WINDOW - STRIDE
        yield slice(None), slice(context, WINDOW), WINDOW
        first = np.flatnonzero(used[:, :context].any(axis=1))
        if len(first):
            yield first, slice(0, context), context

    def folded(self) -> np.ndarray:
        """Q (scaled), K and V side by side."""
        return np.concatenate([self.p["Q"] * np.float32(WIDTH**-0.5), self.p["K"], self.p["V"]], axis=1)

    def attend(self, y: np.ndarray, rows: slice, keys: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the rows over the keys, before division by the sums of each row, and these sums."""
        a = y[:, rows, :WIDTH] @ y[:, :keys, WIDTH: 2 * WIDTH].transpose(0, 2, 1)
        a += self.mask[rows, :keys]
        if max(float(a.max()), -float(np.diagonal(a, rows.start, 1, 2).min())) > SAFE:  # exp needs a shift only then
            a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
        return a, (a.reshape(-1, keys) @ np.ones(keys, dtype=np.float32)).reshape(*a.shape[:2], 1)

    def states(self, ids: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The hidden states at the positions ``used``, one after another."""
        p, out = self.p, np.empty((*ids.shape, WIDTH), dtype=np.float32)
        fold = self.folded()
        fold[:, 2 * WIDTH:] = fold[:, 2 * WIDTH:] @ p["O"]
        for at in range(0, len(ids), INNER):
            x = p["E"].take(ids[at: at + INNER], axis=0)
            x += p["P"]
            y = (x.reshape(-1, WIDTH) @ fold).reshape(*x.shape[:2], 3 * WIDTH)
            here = out[at: at + INNER]
            for which, rows, keys in self.blocks(used[at: at + INNER]):
                a, total = self.attend(y[which], rows, keys)
                o = a @ y[which, :keys, 2 * WIDTH:]
                o /= total
                o += x[which, rows]
                here[which, rows] = o
        return out.reshape(-1, WIDTH).take(np.flatnonzero(used), axis=0)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the output with their biases as a last row (of classes) or column (within them)."""
        p = self.p
        return np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["U"], p["u"][:, None]], axis=1)

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities of ``target`` given ``h``, in blocks that stay in a cache."""
        order = by_class(target)
        target = target[order]
        outer, within = self.tables()
        h = with_ones(h, order)
        logp = np.empty(len(target), dtype=np.float32)
        space = np.empty((min(ROWS, len(h)), CLASS), dtype=np.float32)
        for at in range(0, len(target), ROWS):
            part, goal = h[at: at + ROWS], target[at: at + ROWS]
            z = space[: len(part)]
            logp[at: at + ROWS] = softmax(np.matmul(part, outer, out=z), goal // CLASS)[0]
            for own, rows in segments(goal):
                np.matmul(part[rows], within[own].T, out=z[rows])
            logp[at: at + ROWS] += softmax(z, goal % CLASS)[0]
        out = np.empty(len(target))
        out[order] = logp
        return out

    def gradient(self, ids: np.ndarray, target: np.ndarray, used: np.ndarray) -> tuple[float, dict]:
        """The mean loss at the positions ``used``, and its gradient by each parameter."""
        p, g, d = self.p, {}, WIDTH
        x = p["E"].take(ids, axis=0)
        x += p["P"]
        fold = self.folded()
        y = (x.reshape(-1, d) @ fold).reshape(*x.shape[:2], 3 * d)
        h, kept = np.empty_like(x), []
        for which, rows, keys in self.blocks(used):
            own = y[which]
            a, total = self.attend(own, rows, keys)
            a /= total
            o = a @ own[:, :keys, 2 * d:]
            h[which, rows] = x[which, rows] + (o.reshape(-1, d) @ p["O"]).reshape(o.shape)
            kept.append((which, rows, keys, own, a, o))
        # the output, by rows in the order of their targets' classes
        place = np.flatnonzero(used)
        place = place[by_class(target.reshape(-1)[place])]
        goal = target.reshape(-1)[place]
        n = max(1, len(goal))
        outer, within = self.tables()
        hs = with_ones(h.reshape(-1, d), place)
        z = hs @ outer
        logp, total = softmax(z, goal // CLASS)
        errors(z, total, goal // CLASS, n)
        by_outer, dh = hs.T @ z, z @ outer.T
        parts, by_within, back = segments(goal), np.zeros_like(within), np.empty_like(dh)
        for own, rows in parts:
            np.matmul(hs[rows], within[own].T, out=z[rows])
        more, total = softmax(z, goal % CLASS)
        errors(z, total, goal % CLASS, n)
        for own, rows in parts:
            np.matmul(z[rows].T, hs[rows], out=by_within[own])
            np.matmul(z[rows], within[own], out=back[rows])
        dh += back
        g["C"], g["c"], g["U"], g["u"] = by_outer[:d], by_outer[d], by_within[:, :d], by_within[:, d]
        # the attention
        dx = np.zeros_like(x)
        dx.reshape(-1, d)[place] = dh[:, :d]
        dy, g["O"] = np.zeros_like(y), 0.0
        for which, rows, keys, own, a, o in kept:
            back = dx[which, rows]
            g["O"] = g["O"] + o.reshape(-1, d).T @ back.reshape(-1, d)
            do = (back.reshape(-1, d) @ p["O"].T).reshape(o.shape)
            ds = do @ own[:, :keys, 2 * d:].transpose(0, 2, 1)
            ds -= np.einsum("bid,bid->bi", do, o)[..., None]
            ds *= a
            part = dy[which]  # a copy of the first windows, else dy itself
            part[:, rows, :d] += ds @ own[:, :keys, d: 2 * d]
            part[:, :keys, d: 2 * d] += ds.transpose(0, 2, 1) @ own[:, rows, :d]
            part[:, :keys, 2 * d:] += a.transpose(0, 2, 1) @ do
            dy[which] = part
        dy = dy.reshape(-1, 3 * d)
        by_fold = x.reshape(-1, d).T @ dy
        g["Q"], g["K"], g["V"] = by_fold[:, :d] * np.float32(d**-0.5), by_fold[:, d: 2 * d], by_fold[:, 2 * d:]
        dx = dx.reshape(-1, d)
        dx += dy @ fold.T
        g["P"] = dx.reshape(*ids.shape, d).sum(axis=0)
        at = (ids.reshape(-1, 1) * d + np.arange(d)).reshape(-1)
        g["E"] = np.bincount(at, weights=dx.reshape(-1), minlength=p["E"].size).reshape(-1, d)
        return -float(logp.sum() + more.sum()) / n, g

    def batches(self, sequences: list[np.ndarray]):
        """(owner, inputs, targets, scored positions) of window batches over model-id sequences."""
        sizes = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        owner, start, first = windows(sizes)
        flat = np.concatenate([np.concatenate(([END], s)) for s in sequences] + [np.zeros(WINDOW + 1, dtype=np.int64)])
        offset = np.cumsum(sizes) - sizes
        place = np.arange(WINDOW)
        for at in range(0, len(owner), BATCH):
            w = slice(at, at + BATCH)
            left = (sizes[owner[w]] - start[w])[:, None]
            index = (offset[owner[w]] + start[w])[:, None] + place
            ids = np.where(place < left, flat[index], END)
            target = np.where(place < left - 1, flat[index + 1], END)
            yield owner[w], ids, target, (place >= first[w][:, None]) & (place < left)

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of model ids and its end."""
        out = np.zeros(len(sequences))
        if not sequences:
            return out
        for owner, ids, target, used in self.batches(sequences):
            goal = target[used]
            value = self.log_probabilities(self.states(ids, used), goal) - np.where(goal == RARE, self.rare, 0.0)
            out += np.bincount(np.repeat(owner, used.sum(axis=1)), weights=value, minlength=len(out))
        return out / LOG10

    def dump(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, rank=self.rank, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Attention:
        import io

        with np.load(io.BytesIO(data)) as f:
            return cls({k: f[k] for k in cls.NAMES}, f["rank"])


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Model ids of the subword ids: ranks by their counts, and RARE for those seen once or never."""
    order = np.argsort(-counts, kind="stable")[: RARE - 1]
    order = order[counts[order] > 1]
    rank = np.full(VOCABULARY, RARE, dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return rank


def from_counts(counts: np.ndarray, ends: int) -> Attention:
    """A fresh model whose output biases give the ids and ends the shares they are counted with."""
    model = Attention.fresh(by_frequency(counts))
    n = np.bincount(model.rank, weights=counts, minlength=CLASSES * CLASS) + 0.1
    n[END] += ends
    model.p["u"] = np.log(n).astype(np.float32)
    model.p["c"] = np.log(n.reshape(CLASSES, CLASS).sum(axis=1)).astype(np.float32)
    model.p["u"] -= np.repeat(model.p["c"], CLASS)
    model.p["c"] -= model.p["c"].max()
    return model


def fit(sequences: list[np.ndarray], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11, model: Attention | None = None) -> Attention:
    """Train ``model`` on sequences of subword ids by Adam; a fresh one ranks ids by their frequency in them."""
    if model is None:
        model = Attention.fresh(by_frequency(np.bincount(np.concatenate(sequences), minlength=VOCABULARY)))
    every = [tuple(x) for x in model.batches([model.rank[s] for s in sequences])]
    ids, target, used = (np.concatenate([b[i] for b in every]) for i in (1, 2, 3))
    rng = np.random.default_rng(seed)
    names, shapes = list(model.p), [v.shape for v in model.p.values()]
    cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
    values = np.concatenate([v.reshape(-1) for v in model.p.values()]).astype(np.float32)
    model.p = {k: v.reshape(shape) for k, v, shape in zip(names, np.split(values, cuts), shapes, strict=True)}  # parts of values
    g, m, s, by = (np.zeros_like(values) for _ in range(4))
    slots = {k: v.reshape(shape) for k, v, shape in zip(names, np.split(g, cuts), shapes, strict=True)}
    t, steps = 0, epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        shuffled = rng.permutation(len(ids))
        for at in range(0, len(ids), batch):
            pick = shuffled[at: at + batch]
            for k, part in model.gradient(ids[pick], target[pick], used[pick])[1].items():
                slots[k][...] = part
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for w in (slice(i, i + STEP) for i in range(0, len(values), STEP)):  # Adam, in parts that stay in a cache
                gw, mw, sw, b = g[w], m[w], s[w], by[w]
                np.subtract(gw, mw, out=b)
                b *= np.float32(0.1)
                mw += b
                np.multiply(gw, gw, out=b)
                b -= sw
                b *= np.float32(0.01)
                sw += b
                np.multiply(sw, np.float32(1 / (1 - 0.99**t)), out=b)
                np.sqrt(b, out=b)
                b += np.float32(1e-8)
                np.divide(mw, b, out=b)
                b *= np.float32(now / (1 - 0.9**t))
                values[w] -= b
    return model


def word_ids(words: list[bytes], rank_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the words (each with a space before it), one after another, and how many each has.

    Words go through the encoder a few thousand at a time, one a line: a line end followed
    by a space and a word is always a match of its own in the pre-splitting pattern. Words
    that hold further white space, in Unicode's sense, are encoded alone.
    """
    enc, ids, sizes = encoding(rank_path), [], []
    (line,) = enc.encode_ordinary("\n")
    for at in range(0, len(words), LINES):
        part = [w.decode() for w in words[at: at + LINES]]
        text = "\n " + "\n ".join(part)
        if text.split() != part:  # rare
            found = [encode(" " + w, rank_path) for w in part]
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            ids.append(np.fromiter((i for f in found for i in f), dtype=np.int64, count=int(sizes[-1].sum())))
            continue
        got = np.array(enc.encode_ordinary(text), dtype=np.int64)
        starts = np.flatnonzero(got == line)
        sizes.append(np.diff(np.append(starts, len(got))) - 1)
        ids.append(got[got != line])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(ids or [none]), np.concatenate(sizes or [none])


def gather(flat: np.ndarray, sizes: np.ndarray, offset: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The ids of the words at ``index``, joined; ``offset`` is where each word's ids begin."""
    n = sizes[index]
    ends = np.cumsum(n)
    return flat[np.repeat(offset[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _train(rank_path: str, counts, ends: int):
    def train(batches):
        import pandas as pd

        sequences, held = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                words = words_of_bytes((text or "").encode().lower())
                flat, _ = word_ids(words, rank_path)
                flat = flat[: TRAIN_TOKENS - held]
                if len(flat):
                    held += len(flat)
                    sequences.append(flat)
        if sequences:
            yield pd.DataFrame({"model": [fit(sequences, model=from_counts(counts.value, ends)).dump()]})

    return train


def start_model(docs: DataFrame, rank_path: str, counts: np.ndarray, ends: int) -> Attention:
    """Where the pass over all texts starts: a fit on a bounded part of ``docs`` (doc_id, text), in one task."""
    spark = docs.sparkSession
    prepare(spark)
    if not ends:
        return Attention.even()
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(TRAIN_DOCS)
    sample = docs.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "text")
    train = _train(rank_path, spark.sparkContext.broadcast(counts), ends)
    rows = sample.repartition(1).sortWithinPartitions("key").select("text").mapInPandas(train, "model binary").collect()
    return Attention.load(rows[0]["model"]) if rows else from_counts(counts, ends)


def _pack(sums: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **sums)
    return out.getvalue()


def _add(total: dict[str, np.ndarray], data: bytes) -> None:
    import io

    with np.load(io.BytesIO(data)) as f:
        for k in Attention.NAMES:
            total[k] = total.get(k, 0.0) + f[k]


def _pass(start, folder: str):
    """Sums, weighted by ids, of the parameters that one pass over the training texts of each chunk gives."""

    def learn(batches):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        first = Attention.load(start.value)
        total, weight = {}, 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                    _, held, sizes, index, flat, lengths = _restore(file.read())
                offset, cuts = np.cumsum(lengths) - lengths, np.concatenate([[0], np.cumsum(sizes)])
                sequences = [gather(flat, lengths, offset, index[cuts[i]: cuts[i + 1]]) for i, out in enumerate(held) if not out]
                n = sum(len(x) + 1 for x in sequences)
                if not n:
                    continue
                model = fit(sequences, 1, PASS_BATCH, PASS_RATE, model=Attention({k: v.copy() for k, v in first.p.items()}, first.rank))
                weight += n
                for k, v in model.p.items():
                    total[k] = total.get(k, 0.0) + n * v.astype(np.float64)
        if weight:
            yield pa.RecordBatch.from_pydict({"spot": pa.array([TaskContext.get().partitionId() % GATHERED], pa.int64()), "weight": pa.array([weight], pa.int64()), "sums": pa.array([_pack(total)], pa.binary())})

    return learn


def _gathered(rows):
    import pyarrow as pa

    total: dict[str, np.ndarray] = {}
    for data in rows.column("sums"):
        _add(total, data.as_py())
    return pa.table({"weight": pa.array([sum(rows.column("weight").to_pylist())], pa.int64()), "sums": pa.array([_pack(total)], pa.binary())})


def learn_all(chunks: DataFrame, start: Attention, folder: str) -> Attention:
    """The mean, by ids, of what each chunk's training texts make of ``start``."""
    data = chunks.sparkSession.sparkContext.broadcast(start.dump())
    passed = chunks.select("file").mapInArrow(_pass(data, folder), "spot long, weight long, sums binary")
    total, weight = {}, 0
    for row in passed.groupBy("spot").applyInArrow(_gathered, "weight long, sums binary").orderBy("weight").collect():
        _add(total, row["sums"])
        weight += row["weight"]
    return Attention({k: (v / weight).astype(np.float32) for k, v in total.items()}, start.rank) if weight else start


def train_model(docs: DataFrame, chunks: DataFrame, folder: str, rank_path: str, ends: int) -> Attention:
    """The model of all training texts: ``docs`` (doc_id, text), which ``chunks`` hold beside others."""
    subwords = chunks.select(F.explode(F.arrays_zip("subwords", "sub_counts")).alias("s")).groupBy("s.subwords").agg(F.sum("s.sub_counts").alias("n"))
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    for row in subwords.collect():
        counts[row["subwords"]] = row["n"]
    return learn_all(chunks, start_model(docs, rank_path, counts, ends), folder)


CHUNKS = "chunk long, file string, n_train long, n_ends long, hashes array<long>, counts array<long>, subwords array<long>, sub_counts array<long>"


def _store(sink, docs, index: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Write a chunk: its documents as indices into its distinct words, and these as subword ids. Returns the indices."""
    import io

    import zstandard

    flat = np.concatenate(index).astype(np.int32)
    out = io.BytesIO()
    np.savez(
        out, ids=np.array([d or 0 for d, _ in docs], dtype=np.int64), no_id=np.array([d is None for d, _ in docs]), held=np.array([h for _, h in docs]),
        sizes=np.array([len(x) for x in index], dtype=np.int64), index=flat, subwords=ids.astype(np.uint16), lengths=lengths.astype(np.int32))
    sink.write(zstandard.ZstdCompressor(level=1).compress(out.getvalue()))
    sink.close()
    return flat


def _restore(data: bytes):
    import io

    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as f:
        ids = [None if none else i for i, none in zip(f["ids"].tolist(), f["no_id"].tolist(), strict=True)]
        return ids, f["held"].tolist(), f["sizes"], f["index"].astype(np.int64), f["subwords"].astype(np.int64), f["lengths"].astype(np.int64)


def _chunks(folder: str, rank_path: str):
    """Texts to chunks of about CHUNK_WORDS words: each a file in ``folder`` and a row of its words' hashes."""

    def chunk(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        fs, base = open_filesystem(folder)
        number = TaskContext.get().partitionId() << LOCAL_BITS
        schema = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("n_train", pa.int64()), ("n_ends", pa.int64()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("subwords", pa.list_(pa.int64())), ("sub_counts", pa.list_(pa.int64()))])

        def closed():
            words, name = list(ids), f"{uuid.uuid4().hex}.chunk"
            if len(words) > 1 << WORD_BITS or number >= (TaskContext.get().partitionId() + 1) << LOCAL_BITS:
                raise ValueError(f"more than {1 << WORD_BITS} distinct words in a chunk, or {1 << LOCAL_BITS} chunks in a partition: read the table in more partitions")
            coded, lengths = word_ids(words, rank_path)
            flat = _store(fs.open_output_stream(f"{base}/{name}", compression=None), docs, index, coded, lengths)
            train = np.repeat(np.array([not h for _, h in docs], dtype=bool), [len(x) for x in index])
            counts = np.bincount(flat[train], minlength=len(words)).astype(np.int64)
            hashes = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
            subs = np.bincount(coded, weights=np.repeat(counts, lengths), minlength=VOCABULARY).astype(np.int64)
            used = np.flatnonzero(subs)
            row = [number, name, int(train.sum()), sum(not h for _, h in docs), hashes, counts, used, subs[used]]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        docs, index, held, ids = [], [], 0, _numbering()
        for batch in batches:
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of_bytes((text or b"").lower())
                if docs and held + len(words) > CHUNK_WORDS:
                    yield closed()
                    number += 1
                    docs, index, held, ids = [], [], 0, _numbering()
                docs.append((doc_id, held_out))
                index.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words)))
                held += len(words)
        if docs:
            yield closed()

    return chunk


def _numbering() -> defaultdict:
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    return ids


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, new_words long"


def _score(model_data, folder: str):
    def score(chunks, known):
        import pyarrow as pa

        fs, base = open_filesystem(folder)
        model = Attention.load(model_data.value)
        out, new = [], 0
        for name in chunks.column("file").to_pylist():  # one
            with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                ids, held, sizes, index, flat, lengths = _restore(file.read())
            counts = np.zeros(len(lengths), dtype=np.int64)
            if known.num_rows:
                counts[known.column("at").to_numpy() & ((1 << WORD_BITS) - 1)] = known.column("c").to_numpy()
                new = int(known.column("first").to_numpy(zero_copy_only=False).sum())
            flat, offset = model.rank[flat], np.cumsum(lengths) - lengths
            logs, cuts = np.log10(counts + 0.1), np.concatenate([[0], np.cumsum(sizes)])
            for first in range(0, len(ids), DOCS):
                last = min(first + DOCS, len(ids))
                parts = [index[cuts[i]: cuts[i + 1]] for i in range(first, last)]
                scores = model.score([gather(flat, lengths, offset, part) for part in parts])
                for i, part, value in zip(range(first, last), parts, scores, strict=True):
                    out.append((ids[i], held[i], len(part) + 1, int((counts[part] > 0).sum()), float(logs[part].sum()), float(value), new))
                    new = 0
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in SCORED.split(", ")]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return score


def score_documents(docs: DataFrame, rank_path: str, held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    held_out = (remainder(F.col("doc_id"), 10) == 0) if held_out is None else held_out
    rows = docs.select("doc_id", held_out.alias("held"), "text")
    folder = fresh_path(spark, "lm-texts")
    fs, base = open_filesystem(folder)
    fs.create_dir(base, recursive=True)
    chunks = materialise(rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(_chunks(folder, rank_path), CHUNKS), "lm-chunks")
    seen = chunks.agg(F.sum("n_train").alias("n"), F.sum("n_ends").alias("ends"), F.count("*").alias("chunks")).first()
    ends = seen["ends"] or 0
    model = train_model(rows.where("not held").select("doc_id", "text"), chunks, folder, rank_path, ends)
    data = spark.sparkContext.broadcast(model.dump())
    place = (F.shiftleft(F.col("chunk"), WORD_BITS) + F.col("pos")).alias("at")
    groups = max(1, -(-seen["chunks"] // SALTED))
    salt = F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("salt")
    words = chunks.select("chunk", salt, F.posexplode(F.arrays_zip("hashes", "counts"))).select(F.col("col.hashes").alias("h"), "salt", place, F.col("col.counts").alias("n"))
    same = Window.partitionBy("h")
    parts = words.groupBy("h", "salt").agg(F.sum("n").alias("n"), F.min("at").alias("m"))
    totals = parts.select("h", "salt", F.sum("n").over(same).alias("c"), F.min("m").over(same).alias("m"))
    counted = words.drop("n").join(totals, ["h", "salt"]).select(
        F.shiftright("at", WORD_BITS).alias("chunk"), "at", "c", ((F.col("at") == F.col("m")) & (F.col("c") > 0)).alias("first"))
    scored = chunks.select("chunk", "file").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_score(data, folder), SCORED)
    scored = materialise(scored, "lm-scored")
    n = (seen["n"] or 0) + ends
    v = (scored.agg(F.sum("new_words")).first()[0] or 0) + (ends > 0)
    base = F.col("base") + F.lit(float(np.log10(ends + 0.1))) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
