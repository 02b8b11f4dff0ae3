"""The operators applied to their whole tables, one query each, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, classifier, decontaminate, embedding_dedup, lm, mixing, quality_rules, sharding, simhash, source_audit, token_counts, warc

RANKS = "byte_bpe_multi_50k.tiktoken"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged, f = quality_rules.judge(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"]
    return judged.select("doc_id", *[F.col(f"{f}.{n}").alias(n) for n in names])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labelled = mixing.labelled_domains(docs.select("doc_id", "lang"), table(spark, sf_dir, "labels"))
    mixed, f = mixing.with_rates(docs.select("doc_id", "text", "source"), labelled)
    shares = [F.col(f"{f}.posterior")[i].alias(f"p_{d}") for i, d in enumerate(mixing.TARGETS)]
    return mixed.select("doc_id", "source", F.col(f"{f}.n_tokens").alias("n_tokens"), *shares, F.col(f"{f}.rate").alias("rate"), F.col(f"{f}.copies").alias("copies"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), rank_path())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), rank_path())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded, f = bpe.with_tokens(docs, rank_path(), keep_ids=False)
    return coded.select("doc_id", *[F.col(f"{f}.{n}").alias(n) for n in ("n_tokens", "ids_sha256", "decoded_sha256")])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.compact_arrivals(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    rows = store.read()
    shard = rows.columns[-1]
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"),
        F.col(f"{shard}.file").alias("shard"), F.col(f"{shard}.rows").alias("shard_rows"), F.col(f"{shard}.bytes").alias("shard_bytes"),
        F.col(f"{shard}.tier").alias("tier"), F.lit(store.version()).alias("version"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(docs, *map(public_tokenizers.path, ALIGNED))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, f = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", F.col(f"{f}.n_words").alias("n_words"), F.col(f"{f}.n_hit").alias("n_hit"), F.size(f"{f}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{f}.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col(f"{f}.n_hit") > 0).alias("contaminated"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_quality_rules, op2_mixing, op3_quality_classifier, op4_token_counts, op5_embedding_dedup,
             op6_simhash_dedup, op7_lm_scoring, op8_byte_bpe, op9_sharding, op10_warc,
             op11_tokenizer_alignment, op12_decontamination, op13_source_divergence, pipeline]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
starts AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
wins AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win FROM starts),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c >= 2),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper
  FROM w LEFT JOIN covered ON covered.rid = w.rid),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_symbols::DOUBLE > 0.1::DOUBLE * n_words OR (n_dup_lines >= 3 AND n_dup_lines::DOUBLE > 0.3::DOUBLE * n_lines) OR n_upper::DOUBLE > 0.5::DOUBLE * n_words OR word_chars::DOUBLE > 20.0::DOUBLE * n_words AS soft FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft)::INT)::DOUBLE AS f FROM v WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS h, sum(f * f / n) AS q FROM h),
e AS (SELECT (f + 0.5) / (n + 1) AS mean, q / n - (f / n) * (f / n) - (f + 0.5) / (n + 1) * (1 - (f + 0.5) / (n + 1)) * h / n AS between_hosts FROM t),
s AS (SELECT mean, CASE WHEN between_hosts <= 0 THEN 1000.0 ELSE least(1000.0, greatest(5.0, mean * (1 - mean) / between_hosts - 1)) END AS strength FROM e),
r AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR soft OR coalesce(bad, FALSE)) AS kept, coalesce(bad, FALSE) AS host_rejected
FROM v LEFT JOIN r ON r.source = v.source
"""

OP5_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b, a.vec_id AS ia, b.vec_id AS ib FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT rid AS start, rid AS at FROM v UNION SELECT reach.start, links.b FROM reach JOIN links ON links.a = reach.at),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT reach.start, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.at GROUP BY reach.start)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.start = v.rid LEFT JOIN n ON n.a = v.rid
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::INT, 1)) - 1) * 16
    + CASE WHEN 5 * i // 4 + 2 <= 40 THEN strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 2)::INT, 1)) - 1 ELSE 0 END
    )::INT >> (3 - (5 * i) % 4)::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item, array_to_string(words[i:i+9], ' ') AS gram, 10 AS size FROM (SELECT item, words, unnest(range(1, len(words) - 8)) AS i FROM b WHERE len(words) >= 10)
  UNION SELECT item, array_to_string(words, ' '), len(words) FROM b WHERE len(words) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT size FROM w),
starts AS (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
grams AS (SELECT rid, i, size, array_to_string(words[i:i+size-1], ' ') AS gram FROM starts),
hit AS (SELECT grams.rid, grams.i, grams.size, w.item FROM grams JOIN w ON w.gram = grams.gram AND w.size = grams.size),
spans AS (SELECT DISTINCT rid, i, size FROM hit),
n AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM spans) GROUP BY rid),
t AS (SELECT rid, count(item)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN t ON t.rid = d.rid
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.n + v.v) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT s.lang, s.term, 1 + (1000000000::HUGEINT * (s.n + 1)) // (t.n + v.v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) s
  JOIN v ON v.lang = s.lang JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang) t ON t.lang = s.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op10_warc": OP10_SQL, "op12_decontamination": OP12_SQL,
            "op13_source_divergence": OP13_SQL}
