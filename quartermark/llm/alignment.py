"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte.

A is a byte-level BPE (a ``tokenizers`` file), B a BPE with byte fallback (a ``sentencepiece``
model, which puts a space before the text). Every byte of space + text gets a label: none, the
end of an A token, of a B token, or of both. A regex scans the label string; each span runs up
to the next both-label, and the labels counted in it say how many tokens of A and of B make up
that group. The last tokens of a group are linked. How often an id pair is linked is counted over
all documents and joined back.

Both tokenizers encode pieces of a text by themselves: A the matches of its splitting pattern, B
runs of spaces with what follows up to the next space. So each worker keeps the ids of pieces
that it has met. A's pattern is applied here only to characters that A's own splitter puts in
the same class (asked once for each block of 256); a text with any other character goes through A
whole. B goes by pieces only if no entry of its vocabulary has a space after something else.

Defined results: texts that are null or empty, and those whose tokens' bytes differ from space +
text, have no tokens; strings of special tokens are plain text; repeated rows count by
themselves; extra columns are left alone whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, prepare

#: Pieces that a worker keeps the ids of, for each tokenizer, and their longest.
KEPT, KEPT_CHARS = 250_000, 48
LABELS = np.frombuffer(b"-AB*", dtype=np.uint8)
SPAN = re.compile(rb"[^*]*\*")
#: Unicode's White_Space, as a character class body.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The splitting pattern of the byte-level BPE (a fixed value).
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in entries of a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pieces(dict):
    """The ids of pieces that a tokenizer encodes by themselves, as 32-bit numbers, kept for those met before.

    ``encode`` gives the ids of each of some pieces; ``values`` are the bytes of each id. Of pieces that
    fall out as too many are kept, those met again come back without being encoded anew.
    """

    def __init__(self, encode, values: list[bytes]):
        self.encode, self.values = encode, values
        self.lengths = np.array([len(v) for v in values], dtype=np.int64)
        self.before: dict[str, bytes] = {}
        self.wrong: set[str] = set()  # pieces whose ids have other bytes

    def learn(self, pieces: list[str]) -> None:
        new = []
        for piece in pieces:
            if piece in self.before:
                self[piece] = self.before[piece]
            else:
                new.append(piece)
        for piece, ids in zip(new, self.encode(new) if new else [], strict=True):
            if self.bytes_of(ids) != piece.encode():
                self.wrong.add(piece)
            self[piece] = array("i", ids).tobytes()

    def bytes_of(self, ids) -> bytes:
        return b"".join([self.values[i] for i in ids])

    def ids(self, pieces: list[str]) -> np.ndarray | None:
        """The ids of ``pieces`` in order; None if their bytes are not the pieces'."""
        if len(self) > KEPT:
            self.before = dict(self)
            self.clear()
            self.wrong.intersection_update(self.before)
        new = list(dict.fromkeys(filterfalse(self.__contains__, pieces)))
        if new:
            self.learn(new)
        out = np.frombuffer(b"".join(map(self.__getitem__, pieces)), dtype=np.int32).astype(np.int64)
        right = not self.wrong or self.wrong.isdisjoint(pieces) or self.bytes_of(out) == "".join(pieces).encode()
        for piece in new:
            if len(piece) > KEPT_CHARS:
                del self[piece]
                self.wrong.discard(piece)
        return out if right else None

    def checked(self, ids: list[int], text: str) -> np.ndarray | None:
        return np.array(ids, dtype=np.int64) if self.bytes_of(ids) == text.encode() else None


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        names, at = self.whole.get_vocab(with_added_tokens=True), byte_characters()
        values = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            values[i] = bytes([at[c] for c in name]) if all(c in at for c in name) else name.encode()
        shown, model = {b: c for c, b in at.items()}, self.whole.model
        self.split = regex.compile(SPLIT)
        self.blocks: set[int] = set()
        self.odd: set[str] = set()
        self.pieces = Pieces(lambda new: [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(shown))] for p in new], values)

    def _learn(self, block: int) -> None:
        """Note the characters of a block that A's splitter treats otherwise than the pattern here."""
        theirs = self.whole.pre_tokenizer.pre_tokenize_str
        for c in map(chr, range(block << 8, (block + 1) << 8)):
            if not "\ud800" <= c <= "\udfff" and any(len(theirs(x + c)) != len(self.split.findall(x + c)) for x in "a1!"):
                self.odd.add(c)
        self.blocks.add(block)

    def ids(self, text: str) -> np.ndarray | None:
        used = {" "} if text.isascii() else set(text)
        for block in {ord(c) >> 8 for c in used} - self.blocks:
            self._learn(block)
        if self.odd.isdisjoint(used):
            return self.pieces.ids(self.split.findall(text))
        return self.pieces.checked(self.whole.encode(text, add_special_tokens=False).ids, text)


class SentencePieces:
    """Tokenizer B; it puts the space before a text itself."""

    MARK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        whole = self.whole = SentencePieceProcessor(model_file=path)
        names = [whole.id_to_piece(i) for i in range(whole.get_piece_size())]
        values = [bytes([int(n[3:5], 16)]) if whole.is_byte(i) else n.replace(self.MARK, " ").encode() for i, n in enumerate(names)]
        self.apart = not any(re.search(f"[^{self.MARK}]{self.MARK}", n) for n in names) and self.MARK in names
        space = [whole.piece_to_id(self.MARK)]
        self.split = re.compile(" +[^ ]*")

        def encode(new):
            found = whole.encode([p[1:] for p in new], num_threads=1)
            return [space if p == " " else ids for p, ids in zip(new, found, strict=True)]

        self.pieces = Pieces(encode, values)

    def ids(self, text: str) -> np.ndarray | None:
        """``text`` begins with the space that B puts there."""
        if self.apart and self.MARK not in text:
            return self.pieces.ids(self.split.findall(text))
        return self.pieces.checked(self.whole.encode(text[1:]), text)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, SentencePieces]:
    return ByteLevel(a_path), SentencePieces(b_path)


def tokens(text: str | None, a: ByteLevel, b: SentencePieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of A and of B; none if either's bytes are not space + text."""
    found = (a.ids(" " + text), b.ids(" " + text)) if text else (None, None)
    none = np.empty(0, dtype=np.int64)
    return (none, none) if found[0] is None or found[1] is None else found


def label_string(lengths_a: np.ndarray, lengths_b: np.ndarray) -> bytes:
    """A label for each byte: - none, A the end of an A token, B of a B token, * of both."""
    labels = np.zeros(int(lengths_a.sum()), dtype=np.uint8)
    labels[np.cumsum(lengths_a) - 1] += 1
    labels[np.cumsum(lengths_b) - 1] += 2
    return LABELS[labels].tobytes()


def group_sizes(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A tokens and of B tokens in each span up to a both-label."""
    labels = labels.translate(None, b"-")
    ends = np.cumsum(np.fromiter(map(len, SPAN.findall(labels)), dtype=np.int64))
    at = np.frombuffer(labels, dtype=np.uint8)
    sizes = []
    for label in b"AB":
        n = np.searchsorted(np.flatnonzero(at == label), ends)
        n[1:] -= n[:-1].copy()
        sizes.append(n + 1)
    return sizes[0], sizes[1]


def _listed(ids_a, ids_b, n_a, n_b, names: list[str]) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``; names: ids followed by , | ; in turn."""
    if not len(ids_a):
        return ""
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    group = np.arange(len(n_a))
    kind_a, kind_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    kind_a[end_a - 1], kind_b[end_b - 1] = 1, 2
    codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    codes[np.arange(len(ids_a)) + (end_b - n_b)[np.repeat(group, n_a)]] = ids_a * 3 + kind_a
    codes[np.arange(len(ids_b)) + end_a[np.repeat(group, n_b)]] = ids_b * 3 + kind_b
    return "".join(map(names.__getitem__, codes.tolist()))[:-1]


@lru_cache(maxsize=2)
def _names(size: int) -> list[str]:
    return [f"{i}{end}" for i in range(size) for end in ",|;"]


def with_alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text", out: str | None = None, keep_groups: bool = False) -> tuple[DataFrame, str]:
    """Add a struct ``out``: n_a, n_b, n_groups, groups_sha256, the linked id pairs and, if asked for, the groups.

    ``pair`` holds the distinct linked pairs as a << 32 | b and ``times`` how often each is linked here;
    ``groups`` lists (a ids, b ids).
    """
    prepare(docs.sparkSession)
    out = out or free_name(docs, "aligned")
    more = ", groups array<struct<a: array<long>, b: array<long>>>" if keep_groups else ""

    @F.pandas_udf(f"n_a long, n_b long, n_groups long, groups_sha256 string, pair array<long>, times array<long>{more}")
    def align(texts: pd.Series) -> pd.DataFrame:
        a, b = tokenizers(a_path, b_path)
        names = _names(max(len(a.pieces.values), len(b.pieces.values)))
        rows = []
        for value in texts:
            ids_a, ids_b = tokens(value, a, b)
            n_a, n_b = group_sizes(label_string(a.pieces.lengths[ids_a], b.pieces.lengths[ids_b]))
            end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
            pair, times = np.unique(ids_a[end_a - 1] << 32 | ids_b[end_b - 1], return_counts=True)
            listed = _listed(ids_a, ids_b, n_a, n_b, names)
            row = (len(ids_a), len(ids_b), len(n_a), hashlib.sha256(listed.encode()).hexdigest() if listed else "", pair, times)
            if keep_groups:
                row = (*row, [{"a": x, "b": y} for x, y in zip(np.split(ids_a, end_a[:-1]), np.split(ids_b, end_b[:-1]), strict=True)] if len(n_a) else [])
            rows.append(row)
        return pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups_sha256", "pair", "times"] + ["groups"] * keep_groups)

    return docs.withColumn(out, align(F.col(text))), out


def link_counts(aligned: DataFrame, out: str) -> DataFrame:
    """(pair, n, best): how many links of all documents hold a pair, and whether no pair of its B id has more."""
    found = aligned.select(F.inline(F.arrays_zip(f"{out}.pair", f"{out}.times"))).groupBy("pair").agg(F.sum("times").alias("n"))
    stored = materialise(found.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "links")
    most = stored.groupBy("b").agg(F.max("n").alias("most"))
    return stored.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its counts of tokens, groups and links, and what its links count over all documents."""
    aligned, out = with_alignment(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), a_path, b_path)
    stored = materialise(aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(out).alias("f")), "aligned")
    links = stored.select("row", F.inline(F.arrays_zip("f.pair", "f.times"))).join(link_counts(stored, "f"), "pair")
    sums = links.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = F.lit(0).cast("long")
    return stored.select("row", "doc_id", "f.n_a", "f.n_b", "f.n_groups", "f.groups_sha256").join(sums, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
