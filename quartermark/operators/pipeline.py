"""The write path: fetch candidates, ingest chunks, score, all as DataFrames with period as a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT
from ..functions import periods, text
from ..models.prompts import Spec
from ..models.providers import hashed_embedding, narrate
from ..schemas import GUIDANCE_ITEM
from ..sources.announcements import candidates
from . import scoring, signals
from .chunking import chunk_documents
from .retrieval import period_evidence
from .store import SignalStore, corpus_fingerprint, new_rows, prune, reuse_gate, settled


#: Addresses of picked filings that may go to every task.
MOST_PICKED = 200_000


def requested_periods(now, quarter: int | None = None, year: int | None = None) -> list[int]:
    """period_idx of latest, QoQ and YoY: the asked period, else the last one that ended before ``now``."""
    if quarter is not None and year is not None:
        latest = year * 4 + quarter - 1
    else:
        month = now.month
        latest = (now.year + (month >= 4)) * 4 + (month - 4) % 12 // 3 - 1
    return [latest, latest - 1, latest - 4]


def fetch(announcements: DataFrame, wanted: DataFrame, texts: DataFrame, ticker: str | None, company: str | None, config=DEFAULT) -> DataFrame:
    """Documents of the wanted periods (period_idx, ordinal); texts are (url, text).

    Without a ``ticker`` the announcements bear ticker and company themselves, and all companies are fetched at once,
    each by itself. The picked addresses go to the texts, if there are at most MOST_PICKED, so no other text is shuffled.
    """
    if ticker is not None:
        announcements = announcements.withColumns({"ticker": F.lit(ticker), "company": F.lit(company)})
    picked = settled(candidates(announcements, wanted, most=config.max_docs_per_period, recency=config.recency, by=("ticker",)), "picked")
    if picked.count() <= MOST_PICKED:
        texts = texts.join(F.broadcast(picked.select("url")), "url", "left_semi")
    got = picked.join(texts.withColumnRenamed("text", "raw_text"), "url").where(F.length("raw_text") >= config.min_doc_chars)
    order = wanted.select("period_idx", F.col("ordinal").alias("period_ordinal"))
    once = Window.partitionBy("ticker", F.sha2(F.col("raw_text").cast("binary"), 256)).orderBy("period_ordinal", "rank")
    kept = got.join(F.broadcast(order), "period_idx").withColumn("__n", F.row_number().over(once)).where("__n = 1")
    quarter, year = periods.quarter_of(F.col("period_idx")), periods.year_of(F.col("period_idx"))
    return kept.select(
        text.md5_id(F.col("ticker"), F.col("doc_type"), quarter, year, F.col("url")).alias("doc_id"), "ticker", "company",
        "doc_type", quarter.alias("quarter"), year.alias("fiscal_year"), "event_date", F.col("url").alias("source_url"), F.col("subject").alias("title"),
        F.substring("raw_text", 1, config.doc_max_chars).alias("raw_text"))


def ingest(docs: DataFrame, stored_chunks: DataFrame, config=DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(chunks to keep in the store, counts a period): stale documents go, known chunks are not made anew.

    Counts are totals, so a rerun without new documents still passes the sufficiency gate.
    """
    made = chunk_documents(docs, config)
    kept = prune(stored_chunks, docs)
    fresh = new_rows(made, kept, "chunk_id")
    whole = kept.unionByName(fresh)
    counts = whole.groupBy("ticker", "quarter", "fiscal_year").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))
    return whole, counts.withColumn("sufficient", F.col("n_chunks") >= config.min_chunks_to_score)


def score_plan(chunks: DataFrame, counts: DataFrame, runs: DataFrame, complete: DataFrame, model: str, version: str, profile: str):
    """(reuse, to_score): sufficient periods split by the fingerprint gate."""
    per_doc = chunks.groupBy("ticker", "quarter", "fiscal_year", "doc_id").agg(F.count("*").alias("n_chunks"))
    prints = corpus_fingerprint(per_doc, model=model, version=version, profile=profile)
    ready = prints.join(counts.where("sufficient").select("ticker", "quarter", "fiscal_year"), ["ticker", "quarter", "fiscal_year"], "left_semi")
    return reuse_gate(ready, runs, complete)


def verified(items: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items whose quote stands in the chunk they cite, the dropped ones)."""
    c = chunks.select("chunk_id", text.squash(F.col("text")).alias("__text"))
    joined = items.join(c, "chunk_id", "left").withColumn("__ok", F.coalesce(F.contains("__text", text.squash(F.col("quote"))), F.lit(False)))
    return joined.where("__ok").drop("__text", "__ok"), joined.where("not __ok").drop("__text", "__ok")


def confidence_features(items: DataFrame, words: DataFrame, keys=("ticker", "quarter", "fiscal_year")) -> DataFrame:
    """Features of a period from verified items (kind, tone) and word counts (words)."""
    n = items.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("kind") == "statement", F.col("tone"))), F.lit(0.0)).alias("tone"),
        F.count_if(F.col("kind") == "hedge").alias("n_hedges"), F.count_if(F.col("kind") == "defensive").alias("defensive"),
        F.count_if(F.col("kind") == "superlative").alias("superlatives"), F.bool_or(F.col("kind") == "wide").alias("wide"),
        F.bool_or(F.col("kind") == "avoidance").alias("avoidance"), F.count("*").alias("evidence"))
    return n.join(words, list(keys), "left").withColumn("hedges", F.col("n_hedges") / F.greatest(F.coalesce("words", F.lit(1)), F.lit(1)) * 1000)


def score_confidence(features: DataFrame) -> DataFrame:
    f = {c: F.col(c) for c in ("tone", "hedges", "defensive", "superlatives", "wide", "avoidance")}
    items = scoring.confidence_ledger(f)
    told = F.format_string("Confidence %.1f/10, tone %s.", scoring.confidence_score(f), scoring.tone_label(f))
    parts = F.array(*scoring.sub_dimensions(f).values()).cast("array<double>")
    return features.select(
        "*", told.alias("summary"), parts.alias("sub_dimensions"), scoring.confidence_score(f).alias("score"), scoring.tone_label(f).alias("tone_label"), scoring.confidence_reliability(f, F.col("evidence")).alias("reliability"),
        scoring.drivers(items).alias("drivers"), scoring.manifest(scoring.CONFIDENCE_BASE, items, 0.0, 10.0).alias("manifest"))


#: Kinds of items that the confidence score is made of.
TALK = ("statement", "hedge", "defensive", "superlative", "wide", "avoidance")
PERIOD = ["ticker", "quarter", "fiscal_year"]
#: Standing queries that may go to every task.
MOST_QUERIES = 1000


def embedded(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding", hashed_embedding(F.col("text")))


def asked_specs(spark, specs: dict[str, Spec]) -> dict[str, dict]:
    """The specs with their standing queries' vectors, a bounded number, as ``period_evidence`` takes them."""
    texts = sorted({q for spec in specs.values() for q in spec.queries})
    if len(texts) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} standing queries")
    rows = spark.createDataFrame([(t,) for t in texts], "query string").select("query", hashed_embedding(F.col("query")).alias("v"))
    vectors = {r["query"]: list(r["v"]) for r in rows.collect()} if texts else {}
    plain = {kind: {"queries": [(q, vectors[q]) for q in dict.fromkeys(spec.queries)], "doc_types": spec.doc_types, "sections": spec.sections, "management_only": spec.management_only, "many_periods": spec.many_periods} for kind, spec in specs.items()}
    return plain


def evidence(chunks: DataFrame, queries: DataFrame | dict[str, Spec], config=DEFAULT, scorer: Callable | None = None) -> DataFrame:
    """``chunks`` that retrieval gives for each kind of signal and period, beside (kind, relevance, mode).

    ``queries`` are specs by kind, or standing queries (kind, query) without filters. Chunks without an ``embedding`` get one.
    """
    if isinstance(queries, DataFrame):
        found = queries.select("kind", "query").distinct().limit(MOST_QUERIES + 1).collect()
        queries = {kind: Spec(tuple(sorted(r["query"] for r in found if r["kind"] == kind)), config.top_k) for kind in sorted({r["kind"] for r in found})}
    if "embedding" not in chunks.columns:
        chunks = embedded(chunks)
    return period_evidence(chunks, asked_specs(chunks.sparkSession, queries), scorer=scorer, config=config)


#: What one theme's or risk's stored fact bears beside its period, name and position.
FACTS = {"theme": ("narrative", "themes", ["cur", "sentiment", "key_quotes"]), "risk": ("risk", "risks", ["cur", "severity", "key_quotes"])}


def stored_facts(store: SignalStore) -> dict[str, DataFrame]:
    """Themes and risks of every stored period, as they were counted when it was scored."""
    out = {}
    for name, (kind, column, fields) in FACTS.items():
        rows = store.rows(f"{kind}_signals").select("ticker", periods.idx_of(F.col("quarter"), F.col("fiscal_year")).alias("period_idx"), F.posexplode(column).alias("position", "x"))
        out[name] = settled(rows.select("ticker", "period_idx", "position", f"x.{name}", *[f"x.{f}" for f in fields]), f"stored-{name}")
    return out


def facts_of(items: DataFrame) -> dict[str, DataFrame]:
    """Themes and risks (ticker, period_idx, name, position, cur, ...) of verified items."""
    idx = items.withColumn("period_idx", periods.idx_of(F.col("quarter"), F.col("fiscal_year")))
    common = [F.min("position").alias("position"), F.count("*").cast("int").alias("cur"), signals.quotes_of().alias("key_quotes")]
    themes = idx.where("kind = 'theme'").groupBy("ticker", "period_idx", F.col("name").alias("theme")).agg(*common, F.avg("tone").alias("sentiment"))
    risks = idx.where("kind = 'risk'").groupBy("ticker", "period_idx", F.col("name").alias("risk")).agg(*common, F.max_by("value", scoring.severity_rank(F.col("value"))).alias("severity"))
    return {"theme": themes, "risk": risks}


def shift_signals(facts: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Narrative and risk rows from the ``facts`` of periods, with those ``stored`` of others as baselines."""
    stored = stored or {}
    return {"narrative": signals.narrative_signals(signals.theme_table(facts["theme"], stored=stored.get("theme"))),
            "risk": signals.risk_signals(signals.risk_table(facts["risk"], stored=stored.get("risk")))}


def following(facts: dict[str, DataFrame], stored: dict[str, DataFrame], scored: DataFrame) -> dict[str, DataFrame]:
    """Narrative and risk rows of stored periods right after those just ``scored`` (ticker, period_idx), against their new baselines."""
    after = scored.select("ticker", (F.col("period_idx") + 1).alias("period_idx")).join(scored, ["ticker", "period_idx"], "left_anti")
    own = {n: df.join(after, ["ticker", "period_idx"], "left_semi") for n, df in stored.items()}
    columns = {n: ["ticker", "period_idx", n, "position", *f] for n, (_, _, f) in FACTS.items()}
    known = {n: facts[n].select(*columns[n]).unionByName(stored[n].join(scored, ["ticker", "period_idx"], "left_anti").select(*columns[n])) for n in FACTS}
    return shift_signals(own, known)


def with_periods(rows: DataFrame) -> DataFrame:
    i = F.col("period_idx")
    return rows.withColumns({"quarter": periods.quarter_of(i), "fiscal_year": periods.year_of(i)}).drop("period_idx")


def score_signals(items: DataFrame, words: DataFrame, facts: dict[str, DataFrame] | None = None, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The four signals' rows from verified items.

    Items (ticker, quarter, fiscal_year, chunk_id, kind, quote, tone, position, name, value) are talk, as TALK says,
    ``guidance`` (name: the metric, value: the outcome; what else a guidance item has goes by its own name), ``theme``
    (name, tone) or ``risk`` (name, value: the severity). ``stored`` facts of other periods serve as baselines.
    """
    made = {"confidence": score_confidence(confidence_features(items.where(F.col("kind").isin(*TALK)), words))}
    idx = items.withColumn("period_idx", periods.idx_of(F.col("quarter"), F.col("fiscal_year")))
    more = [c for c in GUIDANCE_ITEM if c in items.columns and c not in ("metric", "outcome")]
    told = idx.where("kind = 'guidance'").select("ticker", "period_idx", "position", F.col("name").alias("metric"), F.col("value").alias("outcome"), *more)
    made["guidance"] = with_periods(signals.guidance_signals(told))
    for kind, rows in shift_signals(facts or facts_of(items), stored).items():
        made[kind] = with_periods(rows)
    return made


def citations(found: DataFrame, most: int = 8) -> DataFrame:
    """(kind, period, citations): the first ``most`` passages of each kind's evidence, each with the period that it comes from."""
    order = Window.partitionBy(*PERIOD, "kind").orderBy(F.desc_nulls_last("relevance"), "doc_id", "char_start", "chunk_id")
    top = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    own = F.concat_ws(" ", "chunk_quarter", F.col("chunk_year").cast("string"))
    cited = F.struct("chunk_id", "doc_type", own.alias("quarter"), "source_url", "speaker", text.citation_quote(F.col("text")).alias("quote"), F.round("relevance", 3).alias("relevance"))
    return top.groupBy("kind", *PERIOD).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", cited.alias("c")))), lambda x: x["c"]).alias("citations"))


def store_rows(kind: str, rows: DataFrame, now) -> DataFrame:
    """A signal's rows under their natural keys, as the store has them."""
    key = text.natural_key(kind, F.col("ticker"), F.col("quarter"), F.col("fiscal_year"))
    rows = rows.withColumns({"id": key, "generated_at": F.lit(now).cast("timestamp_ntz")})
    if "score" in rows.columns:
        rows = rows.withColumn("score", F.col("score").cast("double"))
    for name in ("beats", "misses", "in_line", "withdrawals", "tracked"):
        if name in rows.columns:
            rows = rows.withColumn(name, F.col(name).cast("int"))
    return rows


def narrated(made: dict[str, DataFrame], prose: DataFrame | None, narrator: Callable | None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The signals with their summaries told anew: from the cache ``prose`` (fingerprint, prose), else by ``narrator``, else as they are.

    Also what the cache gains. All four signals of all periods go in one batch.
    """
    if prose is None and narrator is None:
        return made, None
    facts = None
    for kind, rows in made.items():
        drivers = F.transform("drivers", lambda x: x.cast("string")) if "drivers" in rows.columns else F.array("summary")
        one = rows.select(text.natural_key(kind, F.col("ticker"), F.col("quarter"), F.col("fiscal_year")).alias("id"), F.lit(kind).alias("headline"), drivers.alias("drivers"), F.col("summary").alias("fallback"))
        facts = one if facts is None else facts.unionByName(one)
    cache = prose if prose is not None else facts.sparkSession.createDataFrame([], "fingerprint string, prose string")
    told = settled(narrate(facts, cache, narrator), "narrated")
    out = {}
    for kind, rows in made.items():
        own = told.where(F.col("headline") == kind).select("id", "prose")
        keyed = rows.withColumn("__id", text.natural_key(kind, F.col("ticker"), F.col("quarter"), F.col("fiscal_year")))
        out[kind] = keyed.join(own, keyed["__id"] == own["id"], "left").withColumn("summary", F.coalesce("prose", "summary")).drop("__id", "id", "prose")
    return out, told.where("not cached and prose <> fallback").select("fingerprint", "prose").dropDuplicates(["fingerprint"])


def run(spark, announcements: DataFrame, texts: DataFrame, ticker: str | None, company: str | None, now, extract: Callable[[DataFrame], DataFrame], config=DEFAULT,
        store: SignalStore | None = None, queries: DataFrame | dict[str, Spec] | None = None, model: str = "", version: str = "1", profile: str = "",
        scorer: Callable | None = None, prose: DataFrame | None = None, narrator: Callable | None = None, vectors=None) -> dict[str, DataFrame]:
    """Three periods of one company or of all: documents, chunks, counts, the signals of the periods that are to be scored, and marks.

    ``extract`` maps chunks to items, as ``score_signals`` takes them (talk alone, without position, name and value, gives
    confidence alone). With ``queries`` it gets what retrieval finds for each kind instead of all chunks, ranked by ``scorer``
    if there is one. With ``vectors``, a collection, only chunks that it lacks are embedded. ``prose`` and ``narrator`` retell
    summaries. With a ``store``, periods whose documents, model, version and profile are those of their last mark are left
    alone; their stored themes and risks are the baselines of the periods after them, and stored periods right after a
    scored one get their narrative and risk rows anew. Documents, signals and manifests are stored in one commit, marks in
    another; a period is marked once it has all four signals and its retrieval was not degraded.
    """
    wanted = spark.createDataFrame([(p, i) for i, p in enumerate(requested_periods(now))], "period_idx int, ordinal int")
    docs = settled(fetch(announcements, wanted, texts, ticker, company, config), "documents")
    chunks, counts = ingest(docs, chunk_documents(docs.limit(0), config), config)
    chunks = settled(chunks, "chunks")
    counts = settled(counts, "counts")
    ready = counts.where("sufficient").select(*PERIOD)
    out = {"documents": docs, "chunks": chunks, "counts": counts}
    stored = None
    if store is not None:
        complete = None
        for kind in schemas.SIGNALS:
            found = store.rows(f"{kind}_signals").select(*PERIOD).distinct()
            complete = found if complete is None else complete.join(found, PERIOD, "left_semi")
        out["reused"], to_score = score_plan(chunks, counts, store.rows("signal_runs"), complete, model, version, profile)
        prints = settled(to_score, "to-score")
        out["reused"] = settled(out["reused"], "reused")
        ready = prints.select(*PERIOD)
        stored = stored_facts(store)
    usable = settled(chunks.join(ready, PERIOD, "left_semi"), "usable")
    if queries is not None:
        pool = chunks.join(ready.select("ticker").distinct(), "ticker", "left_semi")
        if vectors is not None:
            vectors.upsert(pool, embedded)
            pool = pool.join(vectors.rows().select("chunk_id", "embedding"), "chunk_id")
        used = settled(evidence(pool, queries, config, scorer).join(ready, PERIOD, "left_semi"), "evidence")
    else:
        kinds = F.explode(F.array(*[F.lit(k) for k in schemas.SIGNALS])).alias("kind")
        used = usable.select("*", F.col("quarter").alias("chunk_quarter"), F.col("fiscal_year").alias("chunk_year"), kinds, F.lit(None).cast("double").alias("relevance"), F.lit("all").alias("mode"))
    out["evidence"] = used
    degraded = used.where("mode = 'vector_order_degraded'").select(*PERIOD).distinct()
    items = settled(extract(used if queries is not None else usable), "items")
    good, out["dropped"] = verified(items, chunks)
    good = settled(good, "verified")
    words = usable.groupBy(*PERIOD).agg(F.sum(text.word_count(F.col("text"))).alias("words"))
    if "name" in items.columns:
        facts = {n: settled(df, f"{n}-facts") for n, df in facts_of(good).items()}
        made = score_signals(good, words, facts, stored)
    else:
        facts, made = None, {"confidence": score_confidence(confidence_features(good, words))}
    cited = settled(citations(used), "citations")
    named = docs.groupBy(*PERIOD).agg(F.min("company").alias("company"))
    made, out["prose"] = narrated({kind: settled(rows, kind) for kind, rows in made.items()}, prose, narrator)
    for kind, rows in made.items():
        rows = rows.join(cited.where(F.col("kind") == kind).drop("kind"), PERIOD, "left").join(named, PERIOD, "left")
        out[kind] = settled(rows.withColumn("citations", F.coalesce("citations", F.array().cast(f"array<{schemas.CITATION}>"))), kind)
    if store is not None:
        stamp = F.lit(now).cast("timestamp_ntz")
        tables = {"ingested_documents": docs.withColumn("ingested_at", stamp)}
        manifests = None
        for kind in made:
            rows = store_rows(kind, out[kind], now)
            tables[f"{kind}_signals"] = rows.drop("manifest")
            if "manifest" in rows.columns:
                told = rows.select("id", F.lit(kind).alias("signal_type"), *PERIOD, F.to_json("manifest").alias("manifest"), "generated_at")
                manifests = told if manifests is None else manifests.unionByName(told)
        if manifests is not None:
            tables["signal_manifests"] = manifests
        if facts is not None:
            scored = settled(ready.select("ticker", periods.idx_of(F.col("quarter"), F.col("fiscal_year")).alias("period_idx")).distinct(), "scored")
            for kind, rows in following(facts, stored, scored).items():
                again = store_rows(kind, with_periods(rows), now)
                old = store.rows(f"{kind}_signals")
                kept = old.select(*PERIOD, *[c for c in old.columns if c not in again.columns])
                tables[f"{kind}_signals"] = tables[f"{kind}_signals"].unionByName(again.join(kept, PERIOD), allowMissingColumns=True)
        store.commit(tables)
        marks = markable({k: out[k] for k in made}, degraded) if len(made) == len(schemas.SIGNALS) else prints.select(*PERIOD).limit(0)
        key = text.natural_key("run", F.col("ticker"), F.col("quarter"), F.col("fiscal_year"))
        out["marks"] = settled(marks.join(prints.select(*PERIOD, "fingerprint"), PERIOD).select(key.alias("id"), *PERIOD, "fingerprint", stamp.alias("scored_at")), "marks")
        store.upsert("signal_runs", out["marks"])
    return out


def markable(made: dict[str, DataFrame], degraded: DataFrame, keys=("ticker", "quarter", "fiscal_year")) -> DataFrame:
    """Periods to mark as scored: all four signals are there and no retrieval was degraded."""
    out = None
    for rows in made.values():
        found = rows.select(*keys).distinct()
        out = found if out is None else out.join(found, list(keys), "left_semi")
    return out.join(degraded.select(*keys), list(keys), "left_anti")


def isolated(rows: DataFrame, ok: str = "ok", keys=("ticker", "quarter", "fiscal_year")) -> tuple[DataFrame, DataFrame]:
    """(periods without a failure, failures a period): a failed row never stops the others."""
    bad = rows.where(~F.col(ok)).groupBy(*keys).agg(F.count("*").alias("failed"))
    return rows.select(*keys).distinct().join(bad, list(keys), "left_anti"), bad
