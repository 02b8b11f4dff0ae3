"""Byte-level BPE encoding and decoding with a local rank file.

Texts are cut at safe boundaries: a white-space character after another kind of
character always begins a match of the pre-splitting pattern, so the parts of a long
text encode separately to the same ids as the whole. A run of RUN or more white-space
characters is one match but for its last character (all of it at the end of a text); such
a match goes straight to the byte-pair merge, since the splitting pattern's look-ahead
would use stack in proportion to the run. Decoding concatenates the raw bytes of the ids,
which need not be valid UTF-8 one by one.

Defined results: a null or empty text has no ids; repeated rows are encoded one by one;
other columns are left alone whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare

#: Characters of a text that are encoded at a time.
PART_CHARS = 1 << 16
#: White space (Unicode's White_Space) in runs that the splitting pattern is spared.
RUN = 1 << 14
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(rank_path: str):
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _decimal(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def parts(text: str, size: int = PART_CHARS):
    """Cut ``text`` where a white-space character follows another kind of character."""
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (text[at].isspace() and not text[at - 1].isspace() and not "\x1c" <= text[at] <= "\x1f" and not "\x1c" <= text[at - 1] <= "\x1f"):
            at += 1
        yield text[start:at]
        start = at
    if start < n:
        yield text[start:]


def runs(text: str):
    """(piece, whether it is a match by itself): ``text`` with its long runs of white space apart."""
    start = 0
    for found in SPACES.finditer(text) if len(text) >= RUN else ():
        end = found.end() if found.end() == len(text) else found.end() - 1
        if start < found.start():
            yield text[start: found.start()], False
        yield text[found.start(): end], True
        start = end
    if start < len(text):
        yield text[start:], False


def encode(text: str | None, rank_path: str) -> list[int]:
    if not text:
        return []
    enc = encoding(rank_path)
    if len(text) < RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, match in runs(text):
        if match:
            ids += enc._encode_single_piece(piece)
        else:
            for part in parts(piece):
                ids += enc.encode_ordinary(part)
    return ids


def decode(ids, rank_path: str) -> bytes:
    return encoding(rank_path).decode_bytes(ids)


def with_tokens(docs: DataFrame, rank_path: str, text: str = "text", out: str | None = None, keep_ids: bool = True) -> tuple[DataFrame, str]:
    """Add a struct column ``out`` (ids, n_tokens, ids_sha256, decoded_sha256) to ``docs``."""
    prepare(docs.sparkSession)
    out = out or free_name(docs, "bpe")
    ids_field = "ids array<int>, " if keep_ids else ""

    @F.pandas_udf(f"{ids_field}n_tokens long, ids_sha256 string, decoded_sha256 string")
    def tokenise(texts: pd.Series) -> pd.DataFrame:
        enc = encoding(rank_path)
        names = _decimal(enc.n_vocab + 1)
        rows = []
        for value in texts:
            ids = encode(value, rank_path)
            listed = ",".join([names[i] for i in ids]).encode()
            row = (len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            rows.append((ids, *row) if keep_ids else row)
        return pd.DataFrame(rows, columns=(["ids"] if keep_ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(out, tokenise(F.col(text))), out
