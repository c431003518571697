"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training is one pass: every partition counts hashed 1- to 3-grams by language in dense arrays, Spark
sums the sparse counts, and the driver turns at most ``languages x 2**bits`` sums into a
log-probability matrix. That matrix is broadcast; it has 2**bits rows and a column for each language, 256 KB apiece, of which
the training table names as many as there are, and does not grow with the rows. Scoring
gathers its rows for a block of characters and adds them up by document, all in numpy. No shuffle of
text takes place. A long text is scored in pieces, which lose none of its n-grams and count none twice.

Defined results: a null text, or one without any letter, is ``und`` with score 0.0. Rows with a null
language or text teach nothing. With nothing to learn from every document is ``und``. Ties go to the
language that sorts first. Repeated rows count as often as they occur. Columns named like the results
are replaced; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

BITS = 16
#: Characters held in arrays at once, for one language; more languages take smaller blocks.
BLOCK = 1 << 20
#: Languages that are scored at once.
FEW = 64
#: Characters that pieces of a long text share: one less than the longest n-gram.
OVERLAP = 2
UNDETERMINED = "und"
_SPACE = np.uint32(32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: (2**BITS + 1, languages) float32; the last row is zero and stands for n-grams across documents.
    weights: np.ndarray
    prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _plain(text: str | None) -> str:
    """Lower case, with every run of other characters than letters as one blank, so that a text may be cut anywhere."""
    codes = np.frombuffer(("" if text is None else text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, _SPACE)
    blank = codes == _SPACE
    return codes[~(blank & np.r_[False, blank[:-1]])].tobytes().decode("utf-32-le", "surrogatepass")


def _blocks(texts, limit: int) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
    """Plain texts, each piece behind a 0; the doc index of each piece; how many of its first characters the piece before it had.

    Pieces of a long text overlap by OVERLAP characters, so that each of its n-grams lies in one piece as a whole.
    """
    ids, parts, again, held = [], [], [], 0
    for i, text in enumerate(texts):
        text, at = _plain(text), 0
        while True:
            lead = min(at, OVERLAP)
            piece = text[at - lead : at + limit]
            if held and held + len(piece) > limit:
                yield np.array(ids), "\0".join(["", *parts]), np.array(again)
                ids, parts, again, held = [], [], [], 0
            ids.append(i)
            parts.append(piece)
            again.append(lead)
            held += len(piece) + 1
            at += limit
            if at >= len(text):
                break
    if parts:
        yield np.array(ids), "\0".join(["", *parts]), np.array(again)


def _grams(joined: str, again: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams at each place, the starts of the pieces, and which have letters."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(codes == 0)
    lettered = np.logical_or.reduceat(_letters()[codes], starts)
    out, gram, apart = [], codes.copy(), codes == 0
    none = np.int64(1 << BITS)
    for n in range(1, OVERLAP + 2):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            apart = apart[:-1] | (codes[n - 1 :] == 0)
        hashed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)
        bucket = (hashed >> np.uint32(32 - BITS)).astype(np.int64)
        bucket[apart] = none
        if n == 1:
            bucket[codes == _SPACE] = none
        for k in range(OVERLAP + 1 - n):  # n-grams that lie in the overlap as a whole were counted before
            seen = starts[again >= n + k] + 1 + k
            bucket[seen[seen < len(bucket)]] = none
        out.append(bucket)
    return out, starts, lettered


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            total = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            docs[lang] = docs.get(lang, 0) + len(texts)
            for _, joined, again in _blocks(texts, BLOCK):
                for bucket in _grams(joined, again)[0]:
                    total += np.bincount(bucket, minlength=len(total))
    for lang, total in sums.items():
        total[-1] = docs[lang]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over every row of ``rows`` that has a text and a language."""
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = rows.dropna().mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most 2**BITS + 1 rows for each language
    names = found["lang"].to_numpy().astype(str) if len(found) else np.zeros(0, str)
    known, at = np.unique(names, return_inverse=True)
    languages = known.tolist()
    dense = np.zeros(((1 << BITS) + 1, len(languages)), np.float32 if len(languages) > FEW else np.float64)
    dense[found["bucket"].to_numpy(), at] = found["n"].to_numpy()
    docs = dense[-1].copy()
    dense[-1] = 0
    weights = np.log((dense + 0.5) / (dense.sum(axis=0) + 0.5 * (1 << BITS))) if languages else dense
    weights[-1] = 0
    return Model(languages, weights.astype(np.float32), np.log(docs / docs.sum()) if languages else docs)


def classify(texts, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    n, k = len(texts), len(model.languages)
    total, lettered = np.zeros((n, k)), np.zeros(n, bool)
    for ids, joined, again in _blocks(texts, max(BLOCK // min(max(k, 1), FEW), 4096)):
        grams, starts, has = _grams(joined, again)
        np.logical_or.at(lettered, ids, has)
        for lo in range(0, k, FEW):  # the languages a few at a time
            for bucket in grams:
                at = np.minimum(starts, len(bucket) - 1)
                if len(bucket):
                    sums = np.add.reduceat(model.weights[bucket, lo : lo + FEW], at, axis=0, dtype=np.float64)
                    sums[starts >= len(bucket)] = 0
                    np.add.at(total[:, lo : lo + FEW], ids, sums)
    if not k:
        return [UNDETERMINED] * n, np.zeros(n)
    total += model.prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            lang, score = classify(series.tolist(), shared.value)
            yield pd.DataFrame({"lang": lang, "score": score})

    held = "__language"
    out = docs.withColumn(held, predict(F.col(text).cast("string")))
    return out.withColumns({lang_out: F.col(f"{held}.lang"), score_out: F.col(f"{held}.score")}).drop(held)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
