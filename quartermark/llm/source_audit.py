"""Source divergence audit: how the words of each source differ from those of its language and of other sources.

Each partition counts terms in byte tries, one for a language: inner nodes branch by a byte, and
below them containers hold up to BURST suffixes before they branch in turn. A leaf has a counter
for each source and the number of documents. Words are first counted in blocks; a trie that has
grown to LEAVES counters is handed on in byte order, which is that of UTF-8. The rows are dealt
out by ranges of (language, term), so that each task gets one range of prefixes; there the runs
of all tries merge in that order, and the kept terms go on in chunks. Each chunk gives sums for
all ordered pairs of its language's sources and, for each source, its first candidates by value
and term; Spark adds up the former and ranks the latter.

Probabilities and divergences are whole numbers: counts are smoothed by one, scaled to SCALE and
rounded down, without loss at any size.

Defined results: null text, language and source are empty strings; a text without terms still
makes its group occur; repeated rows count by themselves; a language with no kept term has pairs
of value 0 and no terms; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, prepare

#: Letters: ASCII ones and every byte of other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
#: Counters of a partition's tries, words of a block, and suffixes of a container.
LEAVES, BLOCK_WORDS, BURST = 600_000, 1_500_000, 4096
#: Terms of a chunk; rows of a merging task, about, and of an Arrow batch there.
CHUNK, RANGE_ROWS, RANGE_BATCH = 1 << 14, 400_000, 20_000
#: Sources of a language whose pairs with all others are summed in one row; numbers of a matrix.
BLOCK, CELLS = 256, 1 << 20
#: Groups (language, source) up to which their totals are broadcast.
BROADCAST = 200_000


class Trie:
    """A radix trie over bytes: a node is a list of children by byte, with the leaf of what ends there at 256; a container maps suffixes to leaves.

    A leaf is a list: the number of documents, then source, count, source, count ...
    """

    def __init__(self):
        self.root: dict | list = {}
        self.counters = 0

    def leaf(self, term: bytes) -> list:
        node, above, at = self.root, None, 0
        while type(node) is list:
            above, slot = node, term[at] if at < len(term) else 256
            node = node[slot]
            if node is None:
                node = above[slot] = {} if slot < 256 else [0]
            if slot == 256:
                return node
            at += 1
        suffix = term[at:] if at else term
        found = node.get(suffix)
        if found is None:
            found = node[suffix] = [0]
            if len(node) > BURST:
                self._burst(node, above, term[at - 1] if above else None)
        return found

    def _burst(self, container: dict, above: list | None, slot: int | None) -> None:
        node: list = [None] * 257
        for suffix, leaf in container.items():
            if not suffix:
                node[256] = leaf
            elif node[suffix[0]] is None:
                node[suffix[0]] = {suffix[1:]: leaf}
            else:
                node[suffix[0]][suffix[1:]] = leaf
        if above is None:
            self.root = node
        else:
            above[slot] = node

    def add(self, term: bytes, docs: int, counts) -> None:
        """Merge a term's number of documents and (source, count, source, count ...)."""
        held = self.leaf(term)
        if len(held) == 1:
            held[0] += docs
            held += counts
            self.counters += len(counts) >> 1
            return
        held[0] += docs
        for k in range(0, len(counts), 2):
            source = counts[k]
            for at in range(1, len(held), 2):
                if held[at] == source:
                    held[at + 1] += counts[k + 1]
                    break
            else:
                held += counts[k: k + 2]
                self.counters += 1

    def merge(self, other: Trie) -> None:
        for term, leaf in other.walk():
            self.add(term, leaf[0], leaf[1:])

    def walk(self):
        """(term, leaf) in byte order."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                for suffix in sorted(node):
                    yield prefix + suffix, node[suffix]
                continue
            if node[256] is not None:
                yield prefix, node[256]
            stack += [(prefix + bytes((b,)), node[b]) for b in range(255, -1, -1) if node[b]]


ROWS = "lang string, term string, docs long, source array<string>, count array<long>"
CHUNKS = "lang string, term array<string>, size array<int>, source array<string>, count array<long>"


def _rows(lang: str, walked, names: list[str]):
    """Batches of ROWS for what a walk gives; its sources are numbers of ``names``."""
    import pyarrow as pa

    known = pa.array(names, pa.string())
    while part := list(islice(walked, CHUNK)):
        terms, leaves = zip(*part, strict=True)
        sizes = np.fromiter(map(len, leaves), dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(leaves), dtype=np.int64, count=int(sizes.sum()))
        docs = np.cumsum(sizes) - sizes
        pairs = np.delete(flat, docs).reshape(-1, 2)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes >> 1)]), pa.int32())
        sources = pa.DictionaryArray.from_arrays(pa.array(pairs[:, 0], pa.int32()), known).dictionary_decode()
        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), dtype=np.int64))), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(flat[docs]), pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, pa.array(pairs[:, 1]))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "source", "count"])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


class Counting:
    """The tries of a partition, and the block of words that go there next."""

    def __init__(self):
        self.tries: dict[str, Trie] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.words: list[bytes] = []
        self.texts: list[tuple[int, int]] = []  # of the block: group and number of words of each text

    def read(self, lang: str, source: str, text: bytes) -> None:
        found = TERM.findall(text.lower())
        self.texts.append((self.groups.setdefault((lang, source), len(self.groups)), len(found)))
        self.words += found

    def settle(self) -> None:
        """Count the block by group and term, and add it to the tries."""
        import pyarrow as pa

        if self.words:
            coded = pa.array(self.words, pa.binary()).dictionary_encode()
            terms, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            group, size = (np.array(x, dtype=np.int64) for x in zip(*self.texts, strict=True))
            langs = list(dict.fromkeys(lang for lang, _ in self.groups))
            lang_of = np.array([langs.index(lang) for lang, _ in self.groups])
            n_groups, n_texts = len(self.groups), len(size)
            once, _ = _counted(code * n_texts + np.repeat(np.arange(n_texts), size))  # each term of a text
            held, docs = _counted((once // n_texts) * len(langs) + lang_of[group[once % n_texts]])
            key, n = _counted(code * n_groups + np.repeat(group, size))
            source = key % n_groups
            of = (key // n_groups) * len(langs) + lang_of[source]  # as ``held`` is ordered
            order = np.lexsort((source, of))
            pairs = np.column_stack([source, n])[order].ravel().tolist()
            ends = (2 * np.searchsorted(of[order], held, side="right")).tolist()
            add = [self.tries.setdefault(lang, Trie()).add for lang in langs]
            start = 0
            for k, lang, d, end in zip((held // len(langs)).tolist(), (held % len(langs)).tolist(), docs.tolist(), ends, strict=True):
                add[lang](terms[k], d, pairs[start:end])
                start = end
        self.words, self.texts = [], []

    def handed(self):
        names = [source for _, source in self.groups]
        for lang in list(self.tries):
            yield from _rows(lang, self.tries.pop(lang).walk(), names)


def count_terms(batches):
    """ROWS for (lang, source, text as bytes); every group that occurs also gets a row with an empty term."""
    counting = Counting()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counting.read(*row)
            if len(counting.words) >= BLOCK_WORDS:
                counting.settle()
                if sum(t.counters for t in counting.tries.values()) >= LEAVES:
                    yield from counting.handed()
    counting.settle()
    yield from counting.handed()
    for lang, source in sorted(counting.groups):
        yield from _rows(lang, iter([(b"", [0, 0, 0])]), [source])


def _chunks(rows, last: bool):
    """(chunks of the whole terms of ordered ``rows``, the rows of the last term, which may go on)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.combine_chunks()
    if not rows.num_rows:
        return [], rows
    lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
    new = np.ones(len(term), dtype=bool)
    new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    if not last:
        if len(starts) < 2:
            return [], rows
        rows, rest = rows.slice(0, starts[-1]), rows.slice(starts[-1])
        starts = starts[:-1]
    else:
        rest = rows.slice(rows.num_rows)
    whole = rows.combine_chunks().to_batches()[0] if rows.num_rows else None
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=whole.num_rows))
    docs = np.add.reduceat(whole.column("docs").to_numpy(), starts)
    lists = whole.column("source")
    coded = lists.flatten().dictionary_encode()
    names, n = coded.dictionary, whole.column("count").flatten().to_numpy()
    sizes = pc.list_value_length(lists).to_numpy()
    key = np.repeat(group, sizes) * len(names) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    count, key = np.add.reduceat(n[order], first), key[order][first]
    kept = docs >= LEAST_DOCS
    held = kept[key // len(names)]
    count, source, at = count[held], names.take(pa.array(key[held] % len(names))), (key // len(names))[held]
    kept = np.flatnonzero(kept)
    own = lang.take(pa.array(starts[kept])).dictionary_encode()
    terms, size = term.take(pa.array(starts[kept])), np.bincount(np.searchsorted(kept, at), minlength=len(kept))
    ends = np.concatenate([[0], np.cumsum(size)])
    out, of = [], own.indices.to_numpy()
    for k in range(len(own.dictionary)):
        low, high = np.searchsorted(of, [k, k + 1])
        for a in range(low, high, CHUNK):
            b = min(a + CHUNK, high)
            one = [[own.dictionary[k].as_py()], [terms[a:b]], [size[a:b].astype(np.int32)], [source[ends[a]: ends[b]]], [count[ends[a]: ends[b]]]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
            out.append(pa.RecordBatch.from_arrays([pa.array([x[0].to_pylist() if isinstance(x[0], pa.Array) else x[0]], t) for x, t in zip(one, kinds, strict=True)], names=["lang", "term", "size", "source", "count"]))
    return out, rest


def merge_ranges(batches):
    """The runs of tries over one range of prefixes, in order, merge; terms in LEAST_DOCS documents go on in chunks."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 4 * CHUNK:
            out, rest = _chunks(pa.Table.from_batches(held), False)
            yield from out
            held, n = rest.to_batches(), rest.num_rows
    if held:
        yield from _chunks(pa.Table.from_batches(held), True)[0]


def scaled(counts, totals):
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    counts, totals = np.asarray(counts, dtype=np.int64), np.asarray(totals, dtype=np.int64)
    if counts.max(initial=0) < (1 << 62) // SCALE:
        return 1 + SCALE * (counts + 1) // totals
    exact = 1 + SCALE * (counts.astype(object) + 1) // totals.astype(object)
    return exact.astype(np.int64)


def divergence(p, q):
    return ((p - q) * (p - q)).astype(np.uint64) // q.astype(np.uint64)


FOUND = "lang string, source string, part string, item string, value long"


def _compare(batches):
    """FOUND rows of each chunk: sums of pairs for one block of sources, candidates with the first block."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            lang, block = row["lang"].as_py(), row["block"].as_py()
            sources, totals = row["sources"].as_py(), np.array(row["totals"].as_py(), dtype=np.int64)
            place = {s: k for k, s in enumerate(sources)}
            size = row["size"].values.to_numpy()
            term = np.repeat(np.arange(len(size)), size)
            at = np.fromiter(map(place.__getitem__, row["source"].as_py()), dtype=np.int64, count=len(term))
            count = row["count"].values.to_numpy()
            first = range(block * BLOCK, min((block + 1) * BLOCK, len(sources)))
            sums = np.zeros((len(first), len(sources)), dtype=np.int64)
            step = max(1, CELLS // len(sources))
            starts = np.concatenate([[0], np.cumsum(size)])
            for low in range(0, len(size), step):
                high = min(low + step, len(size))
                part = slice(starts[low], starts[high])
                dense = np.zeros((high - low, len(sources)), dtype=np.int64)
                dense[term[part] - low, at[part]] = count[part]
                p = scaled(dense, totals)
                for k, own in enumerate(first):
                    sums[k] += divergence(p[:, own: own + 1], p).sum(axis=0).astype(np.int64)
            names, out = row["term"].as_py() if block == 0 else [], [[], [], [], []]
            for k, own in enumerate(first):
                others = [j for j in range(len(sources)) if j != own]
                for column, values in zip(out, ([sources[own]] * len(others), ["pair"] * len(others), [sources[j] for j in others], sums[k, others].tolist()), strict=True):
                    column += values
            if block == 0:
                whole = np.add.reduceat(count, starts[:-1]) if len(size) else count
                p, q = scaled(count, totals[at]), scaled(whole, row["whole"].as_py())[term]
                more = np.flatnonzero(p > q)
                value = divergence(p[more], q[more]).astype(np.int64)
                order = more[np.lexsort((term[more], -value, at[more]))]  # terms are in the order of UTF-8
                lead = np.flatnonzero(np.diff(at[order], prepend=-1))
                rank = np.arange(len(order)) - np.repeat(lead, np.diff(lead, append=len(order)))
                best = order[rank < TERM_RANKS]
                for column, values in zip(out, ([sources[j] for j in at[best]], ["term"] * len(best), [names[t] for t in term[best]], divergence(p[best], q[best]).astype(np.int64).tolist()), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows compare a source with each other one, ``term`` rows with its language."""
    spark = docs.sparkSession
    prepare(spark)
    empty = F.lit("")
    read = docs.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).cast("binary").alias("text"))
    counted = materialise(read.mapInArrow(count_terms, ROWS), "audit-tries")
    groups = counted.where("term = ''").select("lang", F.explode("source").alias("source")).distinct()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counted.count() // RANGE_ROWS + 1)
    ordered = counted.where("term <> ''").repartitionByRange(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RANGE_BATCH))  # terms are short
    chunks = materialise(ordered.mapInArrow(merge_ranges, CHUNKS), "audit-chunks")
    prepare(spark)
    sums = chunks.select("lang", F.inline(F.arrays_zip("source", "count"))).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = chunks.groupBy("lang").agg(F.sum(F.size("term")).alias("v"))
    totals = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    both = F.array_sort(F.collect_list(F.struct("source", (F.col("n") + F.col("v")).alias("total"))))
    langs = materialise(totals.groupBy("lang").agg(both.alias("both"), (F.sum("n") + F.first("v")).alias("whole")).select("lang", F.col("both.source").alias("sources"), F.col("both.total").alias("totals"), "whole"), "audit-totals")
    n_groups = langs.agg(F.sum(F.size("sources"))).first()[0] or 0
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / BLOCK).cast("int"))).alias("block")
    with_totals = chunks.join(F.broadcast(langs) if n_groups <= BROADCAST else langs, "lang")
    found = materialise(with_totals.select("lang", "term", "size", "source", "count", "sources", "totals", "whole", blocks).mapInArrow(_compare, FOUND), "audit-found")
    discard(counted, chunks)
    none = langs.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).where("item <> source")
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").union(none.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")) for part, df in (("pair", pairs), ("term", terms))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= TERM_RANKS))
