"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

A word is spelled out in steps: its first 1, 2, ... 8 bytes, then the whole. In each class the probability of a step
given the one before it (its context) is an interpolated Kneser-Ney estimate: absolute discounting of the class's own
counts, and the freed mass, by the number of distinct continuations, spread by what both classes share. That is again an
interpolated estimate, from the pooled counts of the same context and below it the continuation count of the piece
that the step adds, which is the number of distinct contexts in which it stands. A rare expression so keeps the
shared distribution and says little about the class, while families of rare forms with a common
beginning are judged by that beginning. A document counts each distinct word once, so that repeated lines add no evidence.

The log-likelihood ratio of a word is a sum over its steps: what a step adds to its beginning. Those values make up the
model, a table that grows with the corpus and is kept by exact 64-bit keys; steps that would add less than PRUNE nats are left out. The HEAD
most frequent steps at most are broadcast; the other steps of a document, which are rare, are joined to the table.

The score is a logistic function of length-normalised comparisons: the mean log-likelihood ratio of the
document's words, that of the 1, 2, 4, ... 32 words that speak most for toxicity, and the logarithm of the number of words. It is
fitted on training rows that the other half of the training rows scored; the counts cover every labelled training row.

Defined results: null and empty texts get the score of a text without words; null labels and
null texts teach nothing; where either half of the training rows lacks a class,
every score is 0.0. Repeated ids in the labels count once for each label row; repeated documents are scored each.
Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import cut, fold, held_out, likely_members, table

#: Bytes of a word at the end of each step; 0: the whole word.
STEPS = (1, 2, 3, 4, 5, 6, 7, 8, 0)
DISCOUNT = 0.75
#: Weight of the shared distribution in every context, in counts.
SHARED = 50.0
#: Steps whose value is nearer to 0 in every model, in nats, are left out of the table.
PRUNE = 0.25
#: Steps that are broadcast at most.
HEAD = 1 << 20
#: log2 of the bits of the bitmap of all other steps.
REST_BITS = 24
#: The words that speak most for toxicity, so many at a time.
TOP = (1, 2, 4, 8, 16, 32)
#: The logistic function is fitted on about so many training rows at most, those with the smallest hashed ids.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
#: Words that are spelled out at once.
SPELLED = 1 << 16

_ROOT = np.uint64(0)
_REST = (1 << 16) - 1  # the rest of a long word is one of so many pieces and one
_ENDED = 256
#: The models of half 0, of half 1 and of both: the sides (2 * half + toxic) of the ordinary and of the toxic class.
_MODELS = (((0,), (1,)), ((2,), (3,)), ((0, 2), (1, 3)))


def _spelled(hashed: kernels.Hasher, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the steps of each word, and which of them it has: a word ends with the first step that is longer than it."""
    keys = np.empty((len(begin), len(STEPS)), np.uint64)
    has = np.ones(keys.shape, bool)
    for k, n in enumerate(STEPS):
        stop = np.minimum(begin + n, end) if n else end
        ended = np.uint64(1) if not n else (end - begin < n).astype(np.uint64)
        keys[:, k] = kernels.mix(kernels.mix(hashed(begin, stop)) + np.uint64(2 * k) + ended) | np.uint64(1)
        if k:
            has[:, k] = end - begin >= STEPS[k - 1]
    return keys, has


def _words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Over the distinct words of a batch: step keys, which there are, the bytes; and (text, word) of each distinct word of a text."""
    text, word, keys, has, spelled = [], [], [], [], []
    seen = np.zeros(0, np.uint64)
    for ids, buf, ends in kernels.segments([None if t is None else t.lower() for t in texts], kernels.NO_LETTER):
        begin, end = kernels.words(buf, kernels.NO_LETTER)
        hashed = kernels.Hasher(buf)
        own, first, at = np.unique(hashed(begin, end), return_index=True, return_inverse=True)
        k, h = _spelled(hashed, begin[first], end[first])
        raw = buf.tobytes()
        text.append(ids[np.searchsorted(ends, begin, side="right")])
        word.append(at + len(seen))
        keys.append(k)
        has.append(h)
        spelled += [raw[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        seen = np.r_[seen, own]
    if not len(seen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(STEPS)), np.uint64), np.zeros((0, len(STEPS)), bool), []
    _, first, same = np.unique(seen, return_index=True, return_inverse=True)  # segments may share words
    pairs = np.unique(np.concatenate(text) * len(first) + same[np.concatenate(word)])
    return pairs // len(first), pairs % len(first), np.concatenate(keys)[first], np.concatenate(has)[first], [spelled[i] for i in first.tolist()]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by (word, side), combined within a batch."""
    for batch in batches:
        text, word, _, _, spelled = _words(batch["text"])
        cells, n = np.unique(word * 4 + batch["side"].to_numpy(np.int64)[text], return_counts=True)
        yield pd.DataFrame({"word": [spelled[i] for i in (cells // 4).tolist()], **{f"n{s}": np.where(cells % 4 == s, n, 0) for s in range(4)}})


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The steps of distinct words: context, key, piece and documents by side, combined over SPELLED words or so."""

    def combined(words: pd.DataFrame) -> pd.DataFrame:
        size = np.array([len(w) for w in words["word"]], np.int64)
        end = np.cumsum(size)
        begin = end - size
        buf = np.frombuffer(b"".join(words["word"]), np.uint8)
        hashed = kernels.Hasher(buf)
        keys, has = _spelled(hashed, begin, end)
        piece = np.empty(keys.shape, np.int64)
        for k, n in enumerate(STEPS):
            if n:
                piece[:, k] = np.where(size >= n, buf[np.minimum(begin + n, end) - 1].astype(np.int64), _ENDED)
            else:
                piece[:, k] = (hashed(np.minimum(begin + STEPS[k - 1], end), end) >> np.uint64(40)).astype(np.int64) & _REST
            piece[:, k] |= k << 17
        context = np.c_[np.full(len(keys), _ROOT), keys[:, :-1]]
        of = np.nonzero(has)[0]
        flat = pd.DataFrame({"context": context[has].view(np.int64), "step": keys[has].view(np.int64), "piece": piece[has], **{f"n{s}": words[f"n{s}"].to_numpy()[of] for s in range(4)}})
        return flat.groupby(["context", "step", "piece"], as_index=False, sort=False).sum()

    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= SPELLED:
            yield combined(pd.concat(held, ignore_index=True))
            held = []
    if held:
        yield combined(pd.concat(held, ignore_index=True))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0..n3): documents that have the word by side, over all of ``rows`` (text, side)."""
    counted = rows.mapInPandas(_count, "word binary, n0 long, n1 long, n2 long, n3 long")
    return counted.groupBy("word").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(4)])


def step_values(words: DataFrame) -> DataFrame:
    """(key, n, v0, v1, v2): what a step adds to the log-likelihood ratio of a word, in each model; key 0 is what every word begins with."""
    steps = words.mapInPandas(_steps, "context long, step long, piece long, n0 long, n1 long, n2 long, n3 long").repartition("context")
    steps = steps.groupBy("context", "step", "piece").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(4)])
    of = lambda m, c: sum((F.col(f"n{s}") for s in _MODELS[m][c][1:]), F.col(f"n{_MODELS[m][c][0]}"))
    met = lambda n: F.sum((n > 0).cast("long"))
    # at most 257 pieces a level and 2**16 of the last
    pieces = steps.groupBy("piece").agg(*[met(of(m, 0) + of(m, 1)).alias(f"p{m}") for m in range(3)]).toArrow().to_pandas()
    counts = pieces[["p0", "p1", "p2"]]
    pieces[["p0", "p1", "p2"]] = (counts + 0.5) / (counts.groupby(pieces["piece"].to_numpy(np.int64) >> 17).transform("sum") + 1)
    shared = words.sparkSession.createDataFrame(pa.Table.from_pandas(pieces.astype({"piece": np.int64, **{f"p{m}": float for m in range(3)}}), preserve_index=False))
    w = Window.partitionBy("context")
    sums = {}
    for m in range(3):
        a, b = of(m, 0), of(m, 1)
        sums |= {f"s{m}0": F.sum(a).over(w), f"s{m}1": F.sum(b).over(w), f"t{m}0": met(a).over(w), f"t{m}1": met(b).over(w), f"t{m}": met(a + b).over(w)}
    whole = steps.withColumns(sums | {"first": F.col("step") == F.min("step").over(w)}).join(F.broadcast(shared), "piece")
    values, freed = [], []
    for m in range(3):
        n = [of(m, 0), of(m, 1)]
        total, kinds = [F.col(f"s{m}{c}") for c in (0, 1)], [F.col(f"t{m}{c}") for c in (0, 1)]
        rest = lambda c: (DISCOUNT * kinds[c] + SHARED) / (total[c] + SHARED)  # noqa: B023, E731  the mass for what the class has not seen
        below = (F.greatest(n[0] + n[1] - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"t{m}") * F.col(f"p{m}")) / (total[0] + total[1])
        p = [F.greatest(n[c] - DISCOUNT, F.lit(0.0)) / (total[c] + SHARED) + rest(c) * below for c in (0, 1)]
        unseen = F.log(rest(1)) - F.log(rest(0))
        values.append(F.when(n[0] + n[1] > 0, F.log(p[1]) - F.log(p[0]) - unseen).otherwise(0.0))
        freed.append(unseen)
    n = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")
    struct = lambda key, vs: F.struct(F.col(key).alias("key"), n.alias("n"), *[v.alias(f"v{m}") for m, v in enumerate(vs)])
    both = F.when(F.col("first"), F.array(struct("step", values), struct("context", freed))).otherwise(F.array(struct("step", values)))
    added = whole.select(F.inline(both)).groupBy("key").agg(F.max("n").alias("n"), *[F.sum(f"v{m}").cast("float").alias(f"v{m}") for m in range(3)])
    return added.where((F.greatest(*[F.abs(f"v{m}") for m in range(3)]) >= PRUNE) | (F.col("key") == 0))


@dataclass
class Head:
    """The broadcast part of the model: sorted keys with a row of values each, the start value, and the bitmap of all other keys."""

    keys: np.ndarray
    values: np.ndarray
    start: np.ndarray
    rest: np.ndarray


@dataclass
class Model:
    head: Head
    tail: DataFrame
    weights: np.ndarray
    scale: np.ndarray
    fitted: bool = True


def _head(values: DataFrame) -> tuple[Head, DataFrame]:
    """The most frequent steps, at most HEAD, and the table of the others."""
    by_size = values.groupBy(F.least(F.floor(F.log2(F.greatest("n", F.lit(1))) * 4), F.lit(255)).cast("int").alias("size")).count().collect()  # at most 256 rows
    least, total = 256, 0
    for size, n in sorted(((r["size"], r["count"]) for r in by_size), reverse=True):
        if total + n > HEAD:
            break
        least, total = size, total + n
    frequent = (F.least(F.floor(F.log2(F.greatest("n", F.lit(1))) * 4), F.lit(255)) >= least) | (F.col("key") == 0)
    got = values.where(frequent).select("key", "v0", "v1", "v2").toArrow().to_pandas()
    tail = values.where(~frequent)
    place = F.shiftrightunsigned("key", 64 - REST_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - REST_BITS}) & 63 as int))")
    bits = tail.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_pandas()  # at most 2**REST_BITS / 64 rows
    rest = np.zeros(1 << (REST_BITS - 6), np.uint64)
    rest[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    keys, value = got["key"].to_numpy(np.int64).view(np.uint64), got[["v0", "v1", "v2"]].to_numpy(np.float64)
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    start = value[keys == _ROOT].sum(axis=0)
    return Head(keys[keys != _ROOT], value[keys != _ROOT], start, rest), tail


def _looked_up(head: Head, m: int):
    """For each text: the words that the head values in full, summed and the largest; the rest with what the head says."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        h = head.value
        for series in texts:
            text, word, keys, has, _ = _words(series)
            at = np.minimum(np.searchsorted(h.keys, keys), max(len(h.keys) - 1, 0))
            known = has & (h.keys[at] == keys) if len(h.keys) else np.zeros(keys.shape, bool)
            value = h.start[m] + (np.where(known, h.values[at, m], 0.0).sum(axis=1) if len(h.keys) else np.zeros(len(keys)))
            place = (keys >> np.uint64(64 - REST_BITS)).astype(np.int64)
            maybe = has & ~known & ((h.rest[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0)
            sure = ~maybe.any(axis=1)[word]
            n, mine = len(series), value[word]
            total = np.bincount(text[sure], mine[sure], n)
            order = np.lexsort((-mine[sure], text[sure]))
            by_text, sorted_ = text[sure][order], mine[sure][order]
            bounds = np.searchsorted(by_text, np.arange(n + 1))
            top = [sorted_[a : min(b, a + TOP[-1])] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rest: list[list] = [[] for _ in range(n)]
            for t, w in zip(text[~sure].tolist(), word[~sure].tolist(), strict=True):
                rest[t].append({"base": float(value[w]), "keys": keys[w][maybe[w]].view(np.int64)})
            yield pd.DataFrame({"total": total, "words": np.bincount(text, minlength=n), "top": top, "rest": rest})

    return run


def _features(docs: DataFrame, text: str, head, tail: DataFrame, m: int) -> DataFrame:
    """``docs`` with ``__f``, the compared log-likelihoods of the text."""
    known = F.pandas_udf(_looked_up(head, m), "total double, words long, top array<double>, rest array<struct<base:double,keys:array<bigint>>>")
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = cut(docs.withColumns({"__row": F.monotonically_increasing_id(), "__k": known(F.col(text).cast("string"))}).select(*own, "__row", "__k"))
    words = rows.select("__row", F.posexplode("__k.rest").alias("word", "r")).select("__row", "word", "r.base", F.explode("r.keys").alias("key"))
    valued = words.join(tail.select("key", F.col(f"v{m}").alias("v")), "key", "left").groupBy("__row", "word").agg((F.first("base") + F.sum(F.coalesce("v", F.lit(0.0)))).alias("value"))
    more = valued.groupBy("__row").agg(F.sum("value").alias("__more"), F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, TOP[-1]).alias("__highest"))  # the words of one text
    joined = rows.withColumn("__k", F.struct("__k.total", "__k.words", "__k.top")).join(more, "__row", "left")
    best = F.slice(F.sort_array(F.concat("__k.top", F.coalesce("__highest", F.array().cast("array<double>"))), asc=False), 1, TOP[-1])
    mean = lambda k: F.aggregate(F.slice("__best", 1, k), F.lit(0.0), lambda a, x: a + x) / k
    total = (F.col("__k.total") + F.coalesce("__more", F.lit(0.0))) / F.greatest("__k.words", F.lit(1))
    return joined.withColumn("__best", best).select(*own, F.array(total, *[mean(k) for k in TOP], F.log1p("__k.words")).alias("__f"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge-regularised logistic regression by Newton steps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-3, *[0.1] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def train(rows: DataFrame, calibration: DataFrame | None = None) -> Model:
    """``rows``: text, toxic (0/1), half (0/1), those with nulls teach nothing; ``calibration`` are the rows to fit the scale on, by default all."""
    valid = lambda df: df.select("text", "toxic", "half").where(F.col("toxic").isin(0, 1)).dropna()
    words = cut(word_counts(valid(rows).select("text", (F.col("half") * 2 + F.col("toxic")).alias("side"))))
    sides = words.agg(*[F.sum(f"n{s}") for s in range(4)]).first()
    head, tail = _head(cut(step_values(words)))
    width = len(TOP) + 2
    if not all(sides):
        return Model(head, tail, np.zeros(width + 1), np.ones(width), False)
    shared = rows.sparkSession.sparkContext.broadcast(head)
    sample = valid(rows if calibration is None else calibration)
    halves = [_features(sample.where(F.col("half") == h), "text", shared, tail, 1 - h) for h in (0, 1)]
    got = halves[0].unionByName(halves[1]).select("toxic", "__f").toArrow().to_pandas()
    weights, scale = _logistic(np.array(got["__f"].tolist()), got["toxic"].to_numpy(float))
    return Model(head, tail, weights, scale)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without the text, with the probability that it is toxic."""
    if not model.fitted:
        return docs.drop(text).withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model.head)
    weights = model.weights[1:] / model.scale
    z: Column = F.lit(float(model.weights[0]))
    for k, w in enumerate(weights.tolist()):
        z = z + F.element_at("__f", k + 1) * w
    kept = docs.drop(out) if out != text else docs
    return _features(kept, text, shared, model.tail, 2).withColumn(out, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).drop("__f")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, CALIBRATION_ROWS / max(labels.count(), 1)) * (1 << 20))

    def labelled(names: DataFrame) -> DataFrame:
        rows = likely_members(docs.where(~held_out()).select("doc_id", "text"), names, "doc_id").join(names.hint("merge"), "doc_id")
        return rows.withColumn("half", F.when(fold() == 0, 0).otherwise(1))

    model = train(labelled(labels), labelled(labels.where(chosen)))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
