"""Joins over periods: bundles, latest/QoQ/YoY, gap-safe deltas, coverage, fuzzy prior names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash

KEYS = ("ticker", "period_idx")


def bundle(confidence: DataFrame, others: dict[str, DataFrame], keys=KEYS) -> DataFrame:
    """Confidence rows, each with the other signals of its period as structs (null if missing)."""
    out = confidence
    for name, df in others.items():
        packed = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
        out = out.join(packed, list(keys), "left")
    return out


def with_offset(df: DataFrame, columns, offset: int, suffix: str, keys=KEYS) -> DataFrame:
    """``df`` with the columns of the calendar period ``offset`` quarters away, null if there is none."""
    ticker, idx = keys
    other = df.select(ticker, (F.col(idx) - offset).alias(idx), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])
    return df.join(other, list(keys), "left")


def comparison(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Columns of the period, the quarter before (``_qoq``) and the year before (``_yoy``); ``df`` has a row a ticker and period.

    Windows over a ticker's periods, so that ``df`` is computed and shuffled once instead of once a join.
    """
    ticker, idx = keys
    known = F.col(ticker).isNotNull() & F.col(idx).isNotNull()
    periods = Window.partitionBy(ticker).orderBy(idx)

    def away(c: str, n: int) -> Column:
        return F.when(known, F.first(c).over(periods.rangeBetween(-n, -n)))

    return df.select("*", *[away(c, n).alias(f"{c}_{suffix}") for n, suffix in ((1, "qoq"), (4, "yoy")) for c in columns])


def gap_safe_delta(df: DataFrame, column: str, keys=KEYS) -> DataFrame:
    """Change against the calendar predecessor by one window: null across a gap."""
    w = Window.partitionBy(keys[0]).orderBy(keys[1])
    before = F.when(F.lag(keys[1]).over(w) == F.col(keys[1]) - 1, F.lag(column).over(w))
    return df.withColumn(f"{column}_delta", F.col(column) - before)


def latest_period(df: DataFrame, keys=KEYS) -> DataFrame:
    w = Window.partitionBy(keys[0]).orderBy(F.col(keys[1]).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def coverage(tables: dict[str, DataFrame], keys=KEYS) -> DataFrame:
    """Every period of any table, with a flag for each table that has it."""
    marked = None
    for name, df in tables.items():
        rows = df.select(*keys, F.lit(name).alias("kind"))
        marked = rows if marked is None else marked.unionByName(rows)
    return marked.groupBy(*keys).agg(*[F.max((F.col("kind") == n).cast("int")).cast("boolean").alias(f"has_{n}") for n in tables])


def missing_kinds(wanted: DataFrame, tables: dict[str, DataFrame], keys=KEYS) -> DataFrame:
    """(period, kind) of the wanted periods for which a table has no row."""
    kinds = F.explode(F.array(*[F.lit(n) for n in tables])).alias("kind")
    asked = wanted.select(*keys, kinds)
    found = None
    for name, df in tables.items():
        rows = df.select(*keys, F.lit(name).alias("kind"))
        found = rows if found is None else found.unionByName(rows)
    return asked.join(found.distinct(), [*keys, "kind"], "left_anti")


def _tokens(text: Column) -> Column:
    return F.split(text, r"\s+")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(words: Column) -> Column:
    """A hash of each word with the one after it."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, F.lit(" "), b))


class Corpus:
    """Texts (``doc_id``, ``text``) for lookups of quotes; what several lookups need is written once."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str):
        self.texts = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__text")).where("__text is not null").withColumn("__row", F.xxhash64("__d", "__text"))
        self._words: DataFrame | None = None

    def keys(self) -> DataFrame:
        """(__row, __key): hashes of the distinct words and pairs of words in each text."""
        both = let(_tokens(F.col("__text")), lambda w: F.array_distinct(F.concat(_pairs(w), F.transform(w, lambda x: F.xxhash64(x)))))
        return self.texts.select("__row", F.explode(both).alias("__key"))

    def words(self) -> DataFrame:
        """(__row, __word): the distinct words of each text, stored."""
        if self._words is None:
            from .store import settled

            self._words = settled(self.texts.select("__row", F.explode(F.array_distinct(_tokens(F.col("__text")))).alias("__word")), "corpus-words")
        return self._words


#: Characters of the pieces by which a part of a word is looked up among all words.
PIECE = 3


def contained(quotes: DataFrame, quote: str, docs: DataFrame | Corpus, text: str, quote_id: str, doc_id: str) -> DataFrame:
    """(quote_id, doc_id): quotes that a text contains, character for character.

    Words inside a quote (all but its first and last) are whole words of any text that contains it, and so are pairs of
    them. Each text's distinct words and pairs meet those of all quotes, which tells how many texts hold each; a quote
    then goes on by its rarest one, and one that no text holds ends it. Quotes without inner words are looked up among
    the distinct words of all texts, by pieces of PIECE characters of their longest part, and the words that contain it
    lead to their texts. Every join is by equality and without the texts, which come back for the candidates that are
    left; ``contains`` decides. Quotes of white space alone are looked up by their first character.
    """
    corpus = docs if isinstance(docs, Corpus) else Corpus(docs, text, doc_id)
    q = quotes.select(F.col(quote_id).alias("__q"), F.col(quote).alias("__quote")).where(F.length("__quote") > 0)
    q = q.withColumn("__t", _tokens(F.trim("__quote"))).withColumn("__inner", F.slice("__t", 2, F.greatest(F.size("__t") - 2, F.lit(0))))
    met = _by_rarest(q.where(F.size("__inner") > 0), corpus)
    few = q.where(F.size("__inner") == 0)
    if not few.isEmpty():
        met = met.union(_by_part(few, corpus))
    found = met.distinct().join(corpus.texts.select("__row", "__d", "__text"), "__row").join(q.select("__q", "__quote"), "__q")
    return found.where(F.contains("__text", "__quote")).select(F.col("__q").alias(quote_id), F.col("__d").alias(doc_id)).distinct()


def _by_rarest(long: DataFrame, corpus: Corpus) -> DataFrame:
    """(__row, __q): texts that hold the rarest of a quote's pairs of inner words, or its one inner word."""
    from .store import settled

    inner = F.col("__inner")
    asked = long.select("__q", F.explode(F.array_distinct(F.when(F.size(inner) >= 2, _pairs(inner)).otherwise(F.transform(inner, lambda w: F.xxhash64(w))))).alias("__key"))
    spots = settled(corpus.keys().join(asked.select("__key").distinct(), "__key", "left_semi"), "quote-keys")
    held = spots.groupBy("__key").agg(F.count("*").alias("n"))
    rarest = asked.join(held, "__key", "left").groupBy("__q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "__key")).alias("r")).where("r.n > 0")
    return spots.join(rarest.select("__q", F.col("r.__key").alias("__key")), "__key").select("__row", "__q")


def _by_part(few: DataFrame, corpus: Corpus) -> DataFrame:
    """(__row, __q): texts with a word that contains the longest part of a quote of one or two words, or with its white space."""
    longest = F.array_max(F.transform("__t", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    part = few.select("__q", "__quote", longest.alias("__part"))
    asked = part.where(F.length("__part") > 0)
    piece = F.substring("__part", 1, PIECE)
    vocabulary = corpus.words().select("__word").distinct()
    sizes = F.array(*[F.lit(n) for n in range(1, PIECE + 1)])

    def pieces(chars: Column) -> Column:
        of_size = F.transform(sizes, lambda n: F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))))
        return F.array_distinct(F.flatten(F.filter(of_size, lambda x: x.isNotNull())))

    held = vocabulary.select("__word", F.explode(let(F.split("__word", ""), pieces)).alias("__piece"))
    hits = held.join(asked.select("__q", "__part", piece.alias("__piece")), "__piece").where(F.contains("__word", "__part")).select("__q", "__word")
    by_word = corpus.words().join(hits, "__word").select("__row", "__q")
    blank = part.where(F.length("__part") == 0).select("__q", F.substring("__quote", 1, 1).alias("__c"))
    white = corpus.texts.select("__row", F.explode(F.array_distinct(F.split(F.regexp_replace("__text", r"\S+", ""), ""))).alias("__c"))
    return by_word.union(white.join(blank, "__c").select("__row", "__q"))


def prefix_length(quote: Column, text: Column, held=F.contains) -> Column:
    """The length of the longest prefix of ``quote`` that ``text`` contains (begins with, if ``held`` is startswith), by halving."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        found = held(s["t"], F.substring(s["q"], F.lit(1), middle))
        return F.struct(F.when(found, middle).otherwise(s["low"]).alias("low"), F.when(found, s["high"]).otherwise(middle - 1).alias("high"), s["q"].alias("q"), s["t"].alias("t"))

    start = F.struct(F.lit(0).alias("low"), F.length(quote).alias("high"), quote.alias("q"), text.alias("t"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.length(quote) + 1)).cast("int") + 1)
    return F.aggregate(steps, start, lambda s, i: halve(s, i))["low"]


#: White space as ``\s`` has it, and rows of a lookup that may go to every task once they are counted.
WHITE, MOST_BROADCAST = " \t\n\x0b\f\r", 500_000


def _parts(text: Column) -> Column:
    """The words of a text, each with the white space after it."""
    return F.split(text, r"(?<=\s)(?=\S)")


def _next(items: Column, n: int) -> Column:
    return F.slice(items, n, F.size(items))


def longest_prefix(quotes: DataFrame, quote: str, docs: DataFrame, text: str, quote_id: str, doc_id: str) -> DataFrame:
    """(quote_id, prefix, doc_id): the length of the longest prefix of each quote that any text contains, and the least id of such a text (null if none).

    A prefix that goes beyond the third word needs a text that holds the second and third word as a pair: these are the
    candidates, and each is searched by halving. Quotes without a candidate that long go by their first word (see
    ``_by_first_word``); those that begin with white space by halving in rounds, each asking for one prefix a quote.
    """
    from .store import settled

    corpus = Corpus(docs, text, doc_id)
    q = quotes.select(F.col(quote_id).alias("__q"), F.col(quote).alias("__quote")).where(F.length("__quote") > 0)
    words = F.regexp_extract_all("__quote", F.lit(r"(\s*\S+)"), F.lit(1))
    beyond = F.aggregate(F.slice(words, 1, 3), F.lit(0), lambda n, w: n + F.length(w))  # where the third word ends
    t = F.transform(words, lambda w: F.regexp_replace(w, r"\s+", ""))
    long = F.size(words) > 3
    q = settled(q.withColumns({"__end": F.when(long, beyond).otherwise(F.length("__quote")), "__a": F.when(long, F.get(t, F.lit(1))), "__b": F.when(long, F.get(t, F.lit(2)))}), "prefix-quotes")
    w = _tokens(F.col("__text"))
    pairs = corpus.texts.select("__row", F.inline(F.arrays_zip(w.alias("__a"), _next(w, 2).alias("__b"))).alias("__a", "__b"))
    spots = pairs.join(q.where("__a is not null").select("__q", "__a", "__b"), ["__a", "__b"]).select("__row", "__q").distinct()
    both = spots.join(corpus.texts, "__row").join(q.select("__q", "__quote", "__end"), "__q")
    scored = both.select("__q", "__d", "__end", prefix_length(F.col("__quote"), F.col("__text")).alias("n")).where("n > __end")
    found = settled(scored.groupBy("__q").agg(F.min(F.struct((-F.col("n")).alias("n"), "__d")).alias("b")).select("__q", (-F.col("b.n")).alias("prefix"), F.col("b.__d").alias("doc")), "prefix-found")
    left = settled(q.join(found, "__q", "left_anti").select("__q", "__quote", "__end"), "prefix-left")
    blank = F.col("__quote").rlike(r"^\s")
    whole = found.union(_by_first_word(left.where(~blank), corpus))
    odd = left.where(blank)
    if not odd.isEmpty():
        whole = whole.union(_by_rounds(odd, corpus))
    return whole.select(F.col("__q").alias(quote_id), F.col("prefix").cast("int").alias("prefix"), F.col("doc").alias(doc_id))


def _by_first_word(left: DataFrame, corpus: Corpus) -> DataFrame:
    """(__q, prefix, doc): for quotes that begin with a word, the longest prefix within their first ``__end`` characters, three words at most.

    The distinct words of all texts, with the white space after them and the least id of their texts, tell the prefixes
    within the first word and which words end in the whole of it; only places of those words with the right character
    after them are compared with the rest, in one reading of the texts.
    """
    from .store import settled

    head = F.expr("substring(__quote, 1, __end)")
    q = settled(left.select("__q", head.alias("__head"), *[F.regexp_extract(head, r, 1).alias(c) for c, r in (("w", r"^(\S+)"), ("gap", r"^\S+(\s*)"), ("first", r"^\S+\s*(\S?)"))]), "prefix-heads")
    most = q.agg(F.coalesce(F.max(F.length("w")), F.lit(1))).first()[0]
    held = settled(corpus.texts.select("__d", F.explode(_parts(F.col("__text"))).alias("part")).groupBy("part").agg(F.min("__d").alias("__d")), "prefix-words")
    word = F.rtrim("part", F.lit(WHITE))
    held = held.select(word.alias("word"), F.expr("substring(part, length(word) + 1)").alias("white"), "__d").where("word <> ''")
    tails = held.select("*", F.explode(F.expr("sequence(1, length(word))")).alias("at")).select("*", F.expr(f"substring(word, at, {most})").alias("tail"))
    # prefixes within the first word
    starts = q.select("__q", "w", F.explode(F.expr("sequence(1, length(w))")).alias("n")).select("__q", "n", F.expr("substring(w, 1, n)").alias("p"))
    asked = starts.select("p").distinct().withColumn("key", F.substring("p", 1, PIECE))
    keys = F.array_distinct(F.array(*[F.substring("tail", 1, n + 1) for n in range(PIECE)]))
    hits = tails.select("tail", "__d", F.explode(keys).alias("key")).join(asked, "key").where(F.startswith("tail", "p")).groupBy("p").agg(F.min("__d").alias("__d"))
    within = starts.join(hits, "p").select("__q", "n", "__d")
    # words that end in the whole first word, and what follows them
    ends = settled(tails.where("tail = substring(word, at)").join(q, F.col("tail") == F.col("w")).select("__q", "__head", "word", "white", "__d", "w", "gap", "first"), "prefix-ends")
    behind = ends.select("__q", (F.length("w") + prefix_length(F.col("gap"), F.col("white"), F.startswith)).alias("n"), "__d")
    go = ends.where("first <> '' and white = gap").select("__q", F.concat("word", "white").alias("a"), "first", (F.length("w") + F.length("gap")).alias("at"), "__head")
    if go.count() <= MOST_BROADCAST:
        go = F.broadcast(go)
    t = _parts(F.col("__text"))
    places = corpus.texts.select("__d", F.inline(F.arrays_zip(t.alias("a"), _next(t, 2).alias("b"), _next(t, 3).alias("c"))).alias("a", "b", "c")).withColumn("first", F.substring("b", 1, 1))
    after = places.join(go, ["a", "first"]).select("__q", (F.col("at") + prefix_length(F.expr("substring(__head, at + 1)"), F.concat("b", F.coalesce("c", F.lit(""))), F.startswith)).alias("n"), "__d")
    best = settled(within.union(behind).union(after).groupBy("__q").agg(F.min(F.struct((-F.col("n")).alias("n"), "__d")).alias("b")), "prefix-best")
    return q.join(best, "__q", "left").select("__q", F.coalesce(-F.col("b.n"), F.lit(0)).alias("prefix"), F.col("b.__d").alias("doc"))


def _by_rounds(left: DataFrame, corpus: Corpus) -> DataFrame:
    """(__q, prefix, doc): the same for any quotes, by halving the ranges of all quotes in rounds."""
    from .store import settled

    left = settled(left.select("__q", "__quote", F.lit(0).alias("low"), F.col("__end").alias("high"), F.lit(None).cast(dict(corpus.texts.dtypes)["__d"]).alias("doc")), "prefix-rounds")
    while not left.where("low < high").isEmpty():  # a round halves every range; ends of third words bound them
        middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
        asked = left.where("low < high").select("__q", F.expr("substring(__quote, 1, cast(floor((low + high + 1) / 2) as int))").alias("__quote"))
        hits = contained(asked, "__quote", corpus, "__text", "__q", "__d").groupBy("__q").agg(F.min("__d").alias("hit"), F.lit(True).alias("ok"))
        open_ = F.col("low") < F.col("high")
        joined = left.join(hits, "__q", "left")
        ok = F.coalesce("ok", F.lit(False))
        left = settled(joined.select("__q", "__quote", F.when(open_ & ok, middle).otherwise(F.col("low")).alias("low"), F.when(open_ & ~ok, middle - 1).otherwise(F.col("high")).alias("high"), F.when(open_ & ok, F.col("hit")).otherwise(F.col("doc")).alias("doc")), "prefix-rounds")
    return left.select("__q", F.col("low").alias("prefix"), "doc")


def similarity(current: Column, prior: Column) -> Column:
    """difflib's ratio with (current, prior) as its arguments."""

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double")(current, prior)


def could_reach(current: Column, prior: Column, threshold: float) -> Column:
    """Whether difflib's ratio of two names may reach ``threshold``: by their lengths, and by the characters that they share."""
    whole = F.length(current) + F.length(prior)

    def times(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    shared = F.aggregate(F.array_distinct(F.split(current, "")), F.lit(0), lambda n, c: n + F.least(times(current, c), times(prior, c)))
    by_length = 2 * F.least(F.length(current), F.length(prior)) >= threshold * whole
    return by_length & F.when(by_length, 2 * shared >= threshold * whole).otherwise(False)


def match_prior(current: DataFrame, prior: DataFrame, name: str, keys, position: str, threshold: float = 0.85) -> DataFrame:
    """``current`` rows with ``matched``: the prior name that is equal once normalised, else the most similar.

    ``prior`` holds a key's names with their ``position``; of equally similar names the
    first wins. Candidates are compared within a key only, and only pairs that can be similar
    enough by their lengths and characters go to Python.
    """
    cur = current.withColumn("__n", squash(F.col(name)))
    old = prior.select(*keys, F.col(name).alias("__prior"), F.col(position).alias("__pos"), squash(F.col(name)).alias("__pn"))
    pairs = cur.select(*keys, "__n").distinct().join(old, list(keys))
    exact = F.col("__n") == F.col("__pn")
    near = pairs.where(~exact & could_reach(F.col("__n"), F.col("__pn"), threshold)).withColumn("__r", similarity(F.col("__n"), F.col("__pn"))).where(F.col("__r") >= threshold)
    scored = pairs.where(exact).withColumn("__r", F.lit(2.0)).union(near)
    best = scored.groupBy(*keys, "__n").agg(F.max_by("__prior", F.struct("__r", (-F.col("__pos")).alias("p"))).alias("matched"), F.max(F.least("__r", F.lit(1.0))).alias("ratio"))
    return cur.join(best, [*keys, "__n"], "left").drop("__n")
