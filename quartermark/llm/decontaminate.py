"""Benchmark decontamination: documents' words inside any n-gram of a benchmark item, and their removal.

Texts are lower-cased (A-Z) and cut into words. An item's windows are its runs of SIZE words; an
item of fewer words is one window. A set of the windows' hashes, as a table of at most 2 ** MOST_BITS
bits, goes to all tasks; a scan of each document's windows against it leaves few candidates, whose
words are then compared with the windows themselves. That join is a broadcast while there are at
most BROADCAST windows; beyond, Spark shuffles both sides, and rows of a hot window are dealt out.
Everything is an expression of the JVM.

Items that share a window are kept as one list, a class: documents gather classes and then look
up their lists.

Defined results: a null or empty text, or one without words, has no windows; a null item id isn't
listed, though its words are hit; repeated rows count by themselves; items of one id are one item;
extra columns are left alone whatever their names; either table may be empty.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise

SIZE = 10
#: What separates words (a character class body), and words of texts as they are.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++|$)"
#: Bits for each window in the table of hashes, and powers of two of the table's least and greatest size.
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 128, 12, 24
#: Windows that are broadcast for the exact comparison; some 100 bytes each.
BROADCAST = 400_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(f"([^{BETWEEN}]+)"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))


def _gram(words: Column, start: Column, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


class Windows:
    """The windows of a benchmark: ``table`` (gram, size, class) and ``classes`` (class, items), stored."""

    def __init__(self, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE):
        def grams(words: Column) -> Column:
            n = F.size(words)
            long = F.transform(_starts(n, size), lambda i: F.struct(_gram(words, i, size).alias("gram"), F.lit(size).alias("size")))
            whole = F.array(F.struct(F.array_join(words, " ").alias("gram"), n.alias("size")))
            return F.when((n > 0) & (n < size), whole).otherwise(long)

        found = benchmark.select(F.col(item_id).cast("string").alias("item"), F.inline(let(words_of(F.col(text)), grams)))
        listed = materialise(found.groupBy("gram", "size").agg(F.array_sort(F.collect_set("item")).alias("items")), "leak-grams")
        self.classes = materialise(listed.select("items").distinct().select(F.monotonically_increasing_id().alias("class"), "items"), "leak-classes")
        self.table = materialise(listed.join(self.classes, "items").select("gram", "size", "class"), "leak-windows")
        discard(listed)
        self.n = self.table.count()
        self.sizes = sorted(r["size"] for r in self.table.select("size").distinct().collect())  # SIZE numbers at most
        self.bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_WINDOW * self.n).bit_length()))

    def _place(self, window: Column) -> Column:
        """The bit that the hashes of a window's words have."""
        return F.xxhash64(window).bitwiseAND((1 << self.bits) - 1)

    def held(self) -> Column:
        """A scalar: the bits of all windows, 64 in a long."""
        place = self._place(F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)))
        one = F.expr("shiftleft(1L, cast(place & 63 as int))")
        used = self.table.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(one).alias("held"))
        every = self.table.sparkSession.range(1 << (self.bits - 6))
        filled = every.join(used, "id", "left").select("id", F.coalesce("held", F.lit(0).cast("long")).alias("held"))
        return filled.agg(F.array_sort(F.collect_list(F.struct("id", "held")))["held"].alias("held")).scalar()

    def candidates(self, text: Column, held: Column) -> Column:
        """A struct (n, found): the number of words, and (pos, size, gram) of the windows that may be some of these; ``held`` as above."""

        def of_size(size: int, words: Column, hashed: Column, held: Column) -> Column:
            places = F.transform(_starts(F.size(words), size), lambda i: self._place(F.slice(hashed, i, size)))
            hit = F.transform(places, lambda p, i: F.when(F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1, i + 1))
            return F.transform(F.array_compact(hit), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), _gram(words, i, size).alias("gram")))

        def scan(x: Column) -> Column:
            found = F.concat(*[of_size(size, x["words"], x["hashed"], x["held"]) for size in self.sizes]) if self.sizes else F.array()
            return F.struct(F.size(x["words"]).cast("long").alias("n"), found.cast("array<struct<pos: int, size: int, gram: string>>").alias("found"))

        def hashed(x: Column) -> Column:
            return let(F.struct(x["words"], F.transform(x["words"], lambda w: F.xxhash64(w)).alias("hashed"), x["held"]), scan)

        return let(F.struct(words_of(text).alias("words"), held.alias("held")), hashed)


def _hits(candidates: DataFrame, row: str, windows: Windows) -> DataFrame:
    """(row, spans, classes): the occurring windows of each row that has some; spans are (start, end), in order."""
    table = F.broadcast(windows.table) if windows.n <= BROADCAST else windows.table
    found = candidates.select(row, F.inline("found")).join(table.select("gram", "class"), "gram")
    span = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"))
    return found.groupBy(row).agg(F.array_sort(F.collect_list(span)).alias("spans"), F.collect_set("class").alias("classes"))


def covered(spans: Column) -> Column:
    """The number of words in at least one of the ordered ``spans``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(sum_, s):
        more = F.greatest(s["end"] - F.greatest(s["start"], sum_["end"]), F.lit(0))
        return F.struct((sum_["n"] + more).alias("n"), F.greatest(sum_["end"], s["end"]).alias("end"))

    return F.aggregate(spans, start, add)["n"]


def _listed(hits: DataFrame, row: str, windows: Windows) -> DataFrame:
    """(row, items): the ids of the items with occurring windows, in order."""
    held = hits.select(row, F.explode("classes").alias("class")).join(windows.classes, "class")
    return held.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str | None = None, keep_text: bool = True) -> tuple[DataFrame, str]:
    """Add a struct ``out`` (n_words, n_hit, items, spans) to ``docs``; spans count words from 1, their end is exclusive.

    Without ``keep_text`` the text is left out, and no text is written or moved.
    """
    windows = Windows(benchmark)
    out, row, found, held = out or free_name(docs, "leaks"), free_name(docs, "row"), free_name(docs, "found"), free_name(docs, "held")
    kept = docs.columns if keep_text else [c for c in docs.columns if c != text]
    with_bits = docs.withColumn(held, windows.held())  # a step of its own, which Spark merges with the next: the bits are in no row
    stored = with_bits.select(*kept, windows.candidates(F.col(text), F.col(held)).alias(found), F.monotonically_increasing_id().alias(row))
    stored = materialise(stored, "leak-rows")
    hits = materialise(_hits(stored.select(row, F.col(f"{found}.found").alias("found")), row, windows), "leak-hits")
    both = hits.join(_listed(hits, row, windows), row).select(F.col(row), F.struct("spans", "items").alias(out))
    none = "array<struct<start: int, end: int>>"
    spans = F.coalesce(F.col(f"{out}.spans"), F.array().cast(none))
    whole = F.struct(F.col(f"{found}.n").alias("n_words"), covered(spans).alias("n_hit"), F.coalesce(F.col(f"{out}.items"), F.array().cast("array<string>")).alias("items"), spans.alias("spans"))
    return stored.join(both, row, "left").select(*kept, whole.alias(out)), out


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit."""
    found, f = find(docs, benchmark, text)
    return found.where(F.col(f"{f}.n_hit") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the words that are hit, each with what stands between it and the word before."""
    found, f = find(docs, benchmark, text)
    row, piece, at = (free_name(found, x) for x in ("row", "piece", "at"))
    marked = materialise(found.withColumn(row, F.monotonically_increasing_id()), "leak-marked")
    hit = marked.where(F.col(f"{f}.n_hit") > 0)
    pieces = hit.select(row, F.posexplode(F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(0))).alias(at, piece)).withColumn(at, F.col(at) + 1)
    gone = hit.select(row, F.explode(f"{f}.spans").alias("s")).select(row, F.explode(F.sequence(F.col("s.start"), F.col("s.end") - 1)).alias(at)).distinct()
    left = pieces.join(gone, [row, at], "left_anti").groupBy(row).agg(F.array_join(F.array_sort(F.collect_list(F.struct(at, piece)))[piece], "").alias(piece))
    whole = F.when(F.col(f"{f}.n_hit") > 0, F.coalesce(piece, F.lit(""))).otherwise(F.col(text))
    return marked.join(left, row, "left").withColumn(text, whole).select(*docs.columns)
