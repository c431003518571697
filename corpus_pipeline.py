"""Corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing, tokenising.

Each stage reads what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, mixing, ngram_join, secrets
from quarry.llm.common import held_out, shared_folder, table
from quarry.session import ship

#: Posterior below which a document's language counts as undetermined.
LEAST_CERTAIN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is uncertain, go."""
    ship(spark)
    named = langid.identify(docs, langid.learn(docs.where(~held_out())), lang_out="__lang", score_out="__sure")
    return named.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__sure") >= LEAST_CERTAIN)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, null ids last, and of rows that share it the first.

    Rows are decided one by one, whatever their ids; those that link with nothing all stay.
    """
    ship(spark)
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    groups = ngram_join.link_components(rows, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    kept = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(first).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars follows the text."""
    model = secrets.train(secrets.default_samples(docs))
    found = secrets.scan(docs, model, out="__spans")
    text = F.when(F.col("text").isNotNull(), secrets.redacted(F.col("text"), F.col("__spans")))
    clean = found.withColumn("__text", text)
    return clean.withColumns({"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the domains' tokens match the target weights; none is thinned out, rows with null ids or texts stay."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), mixing.TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, with digests of the ids and of what they decode to; a null text has none."""
    ship(spark)
    digest = bpe.digests(F.col("text"), spark, bpe.Vocabulary())
    return docs.select("doc_id", "lang", "source", digest.alias("d")).select("doc_id", "lang", "source", "d.*")


STAGES = [
    ("language_id", language_id),
    ("ngram_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has no form of the language model or the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage outputs lie in the shared folder that the session names."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
