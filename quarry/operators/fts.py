"""Keyword index and BM25 (Robertson and Zaragoza, 2009)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import terms

K1, B = 1.2, 0.75
#: A raw score of so much or more is a keyword score of 1.
FULL_SCORE = 10.0


def query_terms(text: str) -> list[str]:
    """Distinct words of a query, as the analyzer has them."""
    return sorted(set(re.findall(r"\w+", text.lower())))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content", parts: bool = False) -> DataFrame:
    """(term, key, tf)."""
    return chunks.select(key, F.explode(terms(F.col(text), parts)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def doc_lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "content", parts: bool = False) -> DataFrame:
    """(key, dl): words of every chunk, no shuffle."""
    return chunks.select(key, F.size(terms(F.coalesce(text, F.lit("")), parts)).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, total_terms, avgdl."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_terms"), F.avg("dl").alias("avgdl"))


def _is(term: str):
    return lambda word: word == F.lit(term)


def bm25(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "content", parts: bool = False) -> DataFrame:
    """(key, raw) of every chunk that has a query term.

    Only the query's terms are counted, inside each row: the text is read once, and what is shuffled is a
    row for each partition (document frequencies) and the hits.
    """
    wanted = query_terms(query)
    words = terms(F.coalesce(text, F.lit("")), parts)
    count = lambda w: F.struct(F.size(w).alias("dl"), *[F.size(F.filter(w, _is(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    # an array of one, so that the words are made once for a row however many terms are counted in them
    counted = F.transform(F.array(words), count)
    stats = chunks.select(F.inline(counted)).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    found = F.filter(counted, lambda c: F.greatest(F.lit(0), F.lit(0), *[c[f"tf{i}"] for i in range(len(wanted))]) > 0)
    hits = chunks.select(key, F.inline(found)).crossJoin(F.broadcast(stats))  # stats: one row
    raw = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        raw = raw + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return hits.select(key, raw.alias("raw"))


def bm25_indexed(index: DataFrame, lengths: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """(key, raw) from stored postings: only the query's terms are read."""
    found = index.where(F.col("term").isin(query_terms(query)))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(corpus_stats(lengths)))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(key).agg(F.sum(raw).alias("raw"))


def keyword_score(raw: Column | str) -> Column:
    """Raw score to [0, 1]; a missing raw score counts as 0.5."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.5)) / FULL_SCORE)
