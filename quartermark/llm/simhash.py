"""SimHash near-duplicates found by Golay-code keys.

A fingerprint has 64 bits, a majority vote over the XXH64 hashes of a text's shingles.
Two fingerprints link at MAX_BITS = 2 or fewer differing bits. Candidates come from three
segments (22, 21 and 21 bits). By pigeonhole, two differing bits leave at least one of
three segments untouched. Each segment, padded to 23 bits, is also decoded by the perfect
binary Golay code together with its 23 one-bit neighbours, which yields one or six codeword
indices; two words at distance two or less share one, since a word halfway between them
lies in both neighbourhoods. So a pair that links shares at least one of the keys
(segment s exact, a codeword index of segment s+1), of which a fingerprint has at most 18.

Equal fingerprints are one node, so exact copies cost nothing. Buckets of up to
BUCKET distinct fingerprints are joined pair by pair and verified. Larger ones go an exact
linear way: each member is filed under itself and its 64 one-bit neighbours; members that
meet there differ in at most two bits, and links to the least of them connect them all.

Defined results: a null or empty text has no words and fingerprint zero, linked like any
other; a null id is never the name of a component unless all of its ids are null; repeated
rows are documents of their own with one id; very long texts are hashed whole; other
columns are left alone whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, prepare, words_of_bytes
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET = 32
#: Generator polynomial of the binary Golay code of length 23: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included."""
    from xxhash import xxh64_intdigest

    words = words_of_bytes((text or "").encode().lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)


def majority(found: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        block = found[at: at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > len(found)).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(hashes(text, shingle))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of low and high bits of a word, and the error pattern of each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 11, dtype=np.int32)
    for i in range(12):
        low[1 << i: 2 << i] = low[: 1 << i] ^ unit[i]
    for i in range(11):
        high[1 << i: 2 << i] = high[: 1 << i] ^ unit[12 + i]
    errors = np.zeros(1 << 11, dtype=np.int32)
    for a in range(23):
        errors[unit[a]] = 1 << a
        for b in range(a):
            errors[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return low, high, errors


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (12 information bits) of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices near each 23-bit word, ascending; one or six are distinct."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23, dtype=np.int64))[None, :]], axis=1)
    return np.sort(codeword(near), axis=1)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``prints``, key) of every key of every fingerprint."""
    bits = prints.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        near = codeword_keys(parts[(s + 1) % 3])
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, _ = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(s) << 60) | (parts[s][row] << 12) | near[new])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    import pyarrow as pa

    def keyed(prints):
        row, key = golay_keys(prints)
        for at in range(0, len(row), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(prints[row[at: at + (1 << 16)]]), pa.array(key[at: at + (1 << 16)])], names=["fp", "key"])

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= 1 << 13:
            yield from keyed(np.concatenate(held))
            held, n = [], 0
    if n:
        yield from keyed(np.concatenate(held))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> tuple[DataFrame, str]:
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    out = free_name(docs, "fp")
    return docs.withColumn(out, prints(F.col(text))), out


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect every two of the distinct fingerprints ``fp`` within MAX_BITS."""
    keyed = prints.select("fp").mapInArrow(_keys, "fp long, key long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, "key"), "simhash-keys")
    small = shared.where(F.col("n") <= BUCKET)
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    crowded = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    spots = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = crowded.select("fp", F.explode(spots).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    # at most 65 distinct fingerprints lie within one bit of a spot
    met = near.groupBy("spot").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(fp, component_fp): the least-numbered member of each fingerprint's group, for linked ones."""
    return connected_components(links(prints), "simhash-cc")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the least id reachable."""
    marked, f = with_fingerprint(docs.select(doc_id, text), text, shingle)
    marked = materialise(marked.select(F.col(doc_id).alias("doc_id"), F.col(f).alias("fp")), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    named = distinct.join(groups(distinct).withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialise(named, "simhash-named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialise(named.join(ids, "component").select("fp", "component_id"), "simhash-ids")
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the least id, nulls last."""
    marked, f = with_fingerprint(docs, text, shingle)
    row = free_name(docs, "row")
    marked = materialise(marked.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    distinct = materialise(marked.groupBy(F.col(f).alias("fp")).agg(F.min(order).alias("least")), "simhash-distinct")
    named = distinct.join(groups(distinct).withColumnRenamed("node", "fp"), "fp", "left")
    winners = named.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("least").alias("least"))
    chosen = winners.select(F.col("least.row").alias(row))
    return marked.join(chosen, row, "left_semi").drop(f, row)


def hex_print(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
