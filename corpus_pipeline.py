"""The corpus pipeline: five operators in turn, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as parquet in the shared folder and reads it again as the next one's documents.
Empty tables give empty results; repeated rows are documents of their own, of which
near-dedup keeps one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermark.llm import bpe, classifier, mixing, near_copies, quality_rules
from quartermark.llm.common import materialise
from quartermark.llm.queries import rank_path, table

#: A classifier and a least-squares fit have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier, fitted on the labelled table, scores 0.7 or more; null texts score as empty ones."""
    weights = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored, s = classifier.with_score(docs, weights)
    return scored.where(F.col(s) >= classifier.THRESHOLD).select(*docs.columns)


def host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the rules and whose host is not rejected as a whole; without a source there is no host, a null text fails."""
    judged, f = quality_rules.judge(docs, keep_text=True)
    return judged.where(F.col(f"{f}.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares 0.8 of its five-word shingles, that with the least id (a null id loses).

    Texts without words are alike; of equal least ids one row stays. Candidates come from SimHash fingerprints by Golay-code
    keys, which reach two differing bits; pairs this similar differ in up to 11, so MinHash bands bring together the rest.
    """
    return near_copies.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by their fitted rates, so that domains meet their target shares."""
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    mixed, f = mixing.with_rates(docs, labelled, keep_text=True)
    copies = F.col(f"{f}.copies")
    once = F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>")))
    return mixed.select(*docs.columns, once.alias(f)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with hashes of the ids and of the bytes decoded from them; a null text has none."""
    coded, f = bpe.with_tokens(docs.select("doc_id", "source", "text"), rank_path())
    return coded.select("doc_id", "source", F.col(f"{f}.n_tokens").alias("n_tokens"), F.col(f"{f}.ids").alias("token_ids"),
                        F.col(f"{f}.ids_sha256").alias("ids_sha256"), F.col(f"{f}.decoded_sha256").alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", host_rules),
    ("SimHash near-dedup, then bands to 0.8 of five-word shingles", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return docs
