import hashlib
import random
from collections import Counter

import edge
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartermark.llm import alignment, queries

A_PATH, B_PATH = map(public_tokenizers.path, queries.ALIGNED)
ODD = [
    "", None, " ", "  ", "a", "a ", " a", "a  b   c ", "\n\n \n", "x y", "<|endoftext|> and </s> <0x41>", "it's we'LL don't  '", "日本語 テキスト", "1½ ²³ Ⅷ 12345678",
    "mark ▁ here", "ȩ́", "\x00\x01 \x7f", "👩‍👩‍👧 🇩🇪", "ᡐ Ֆ ՠ ֈ ࢏", "tab\tand\r\nline\x0b\x0c\x1c\x1d", "a" * 5000, " " * 3000 + "b", " x　　y", "ﬁn ſ İ ẞ",
]


def plain(text):
    """Token ids, and groups as lists, from the whole text and sets of end offsets."""
    a, b = alignment.tokenizers(A_PATH, B_PATH)
    if not text:
        return [], [], []
    ids_a, ids_b = a.whole.encode(" " + text, add_special_tokens=False).ids, b.whole.encode(text)
    bytes_a, bytes_b = [a.pieces.values[i] for i in ids_a], [b.pieces.values[i] for i in ids_b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return ids_a, ids_b, groups


def listed(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def plain_rows(rows):
    found = [(i, *plain(t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = Counter()
    for i, ids_a, ids_b, groups in found:
        n = [(counts[g[0][-1], g[1][-1]], best[g[1][-1]]) for g in groups]
        sha = hashlib.sha256(listed(groups).encode()).hexdigest() if groups else ""
        out[i, len(ids_a), len(ids_b), len(groups), len(groups), sum(x == y for x, y in n), sum(x for x, _ in n), sha] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(found, rows):
    assert found.columns == COLUMNS
    assert Counter(tuple(r) for r in found.collect()) == plain_rows(rows)


def test_awkward_documents(spark):
    docs = edge.documents(spark, edge.texts() + ODD)
    same(alignment.align_documents(docs, A_PATH, B_PATH), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert alignment.align_documents(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_the_query_over_the_whole_table(spark):
    from conftest import SF

    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    same(queries.op11_tokenizer_alignment(spark, SF), rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.text(alphabet="ab 1'\n\t é▁s½.,", max_size=60))
def test_pieces_encode_as_the_whole(some, more):
    a, b = alignment.tokenizers(A_PATH, B_PATH)
    ids_a, ids_b = alignment.tokens(some + more, a, b)
    want_a, want_b, _ = plain(some + more)
    assert ids_a.tolist() == want_a and ids_b.tolist() == want_b


def test_pieces_are_forgotten_when_too_many(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 5)
    a, b = alignment.ByteLevel(A_PATH), alignment.SentencePieces(B_PATH)
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(rng.choice(["one", "two", "thréé", "4", "five!", "w" * 60]) for _ in range(40))
        ids_a, ids_b = alignment.tokens(text, a, b)
        assert (ids_a.tolist(), ids_b.tolist()) == plain(text)[:2] and len(a.pieces) < 60


@pytest.mark.parametrize("labels, sizes", [(b"", ([], [])), (b"*", ([1], [1])), (b"-A-B*A*", ([2, 2], [2, 1])), (b"AAB-*", ([3], [2]))])
def test_label_spans(labels, sizes):
    a, b = alignment.group_sizes(labels)
    assert (a.tolist(), b.tolist()) == sizes


def test_groups_are_kept_when_asked_for(spark):
    docs = edge.documents(spark, ["don't stop", "", None, "日本"])
    found, f = alignment.with_alignment(docs, A_PATH, B_PATH, keep_groups=True)
    assert found.columns == [*docs.columns, f]
    for r in found.collect():
        assert [(g["a"], g["b"]) for g in r[f]["groups"]] == plain(r["text"])[2]


def test_pieces_met_again_are_not_encoded_anew(monkeypatch):
    """What falls out as too many comes back from what was kept before, and each text's new pieces are encoded in one call."""
    monkeypatch.setattr(alignment, "KEPT", 4)
    a, b = alignment.ByteLevel(A_PATH), alignment.SentencePieces(B_PATH)
    for kept in (a.pieces, b.pieces):
        asked, real = [], kept.encode
        kept.encode = lambda new, asked=asked, real=real: asked.append(list(new)) or real(new)
        for _ in range(3):
            found = kept.ids([" one", " two", " one", " three", " four", " five"])
            assert kept.bytes_of(found) == b" one two one three four five"
        assert asked == [[" one", " two", " three", " four", " five"]]
