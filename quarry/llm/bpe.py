"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Each distinct pre-token is a row of byte ids, padded to the width of its length bucket. In every
round each row merges its leftmost pair of minimum rank: the ranks of all neighbours come from a
hashed pair table, the row closes the gap, and only the two pairs beside the merge are looked up
again; rows without a mergeable pair leave the matrix. A pair's rank is that of the bytes it joins,
as tiktoken has it, and a pre-token that is itself a token is taken whole. Pre-tokens longer than the
widest bucket are merged by a heap with the same order, since a matrix that wide costs the square.

Defined results: null and empty texts have no tokens; all bytes are tokens, so every text has an
encoding; decoding a null list gives empty bytes, and an id outside the vocabulary raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashtable import HashTable
from .kernels import utf8
from .pretokens import Pretokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Widths of the matrices, in bytes.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
#: Rows of a matrix at once.
ROWS = 1 << 15
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Token bytes by id, and the rank of each pair of tokens whose joined bytes are a token."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = HashTable(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int64))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; padding (-1) pairs with nothing."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        return np.where((a < 0) | (b < 0), _NONE, self.pairs.get(keys.ravel(), _NONE).reshape(a.shape))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > WIDTHS[-1]:
                out[i] = self._by_heap(piece)
            else:
                by_width.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append(i)
        for width, members in by_width.items():
            for lo in range(0, len(members), ROWS):
                rows = members[lo : lo + ROWS]
                for i, ids in zip(rows, self._by_matrix([pieces[i] for i in rows], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> Iterator[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        done = np.full_like(ids, -1)
        rows = np.arange(len(pieces))
        ranks = np.full(ids.shape, _NONE)  # ranks[r, i]: of ids[r, i] with ids[r, i + 1]
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                done[rows[over]] = ids[over]
                rows, ids, ranks, at, best = (x[~over] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = best
            behind = columns > at[:, None]
            ids[:, :-1] = np.where(behind[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            after = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
            ranks[each, at] = self.rank(best, after)
            some = at > 0
            ranks[each[some], at[some] - 1] = self.rank(ids[each[some], at[some] - 1], best[some])
        left = done >= 0
        flat = done[left].tolist()
        end = 0
        for n in left.sum(axis=1).tolist():
            yield flat[end : end + n]
            end += n

    def _by_heap(self, piece: bytes) -> list[int]:
        """The same merges in the same order: by rank, then from the left."""
        tokens: list[bytes] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(tokens) and (r := self.ranks.get(tokens[i] + tokens[after[i]])) is not None:
                heapq.heappush(heap, (r, i, tokens[i], tokens[after[i]]))

        for i in range(len(tokens)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is not left or j >= len(tokens) or tokens[j] is not right:
                continue
            tokens[i], tokens[j] = left + right, b""
            after[i] = after[j]
            if after[j] < len(tokens):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[t] for t in tokens if t]

    def decode(self, ids) -> bytes:
        try:
            return b"".join([self.tokens[i] for i in ids])
        except KeyError as e:
            raise ValueError(f"no token has the id {e}") from None


def _pretokens(vocabulary: Vocabulary, shape) -> Pretokens:
    return Pretokens(public_tokenizers.PATTERN, lambda new: [shape(ids) for ids in vocabulary.encode_pieces([utf8(t) for t in new])])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pre = _pretokens(shared.value, lambda x: x)
        for texts in it:
            yield pd.Series([[i for piece in doc for i in piece] for doc in pre.documents(texts.tolist())], dtype=object)

    return docs.withColumn(out, ids(F.col(text).cast("string")))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that each list of ids stands for."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def decoded(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in it:
            yield pd.Series([shared.value.decode(() if x is None else x) for x in lists], dtype=object)

    return docs.withColumn(out, decoded(ids))


def digests(text: Column, spark: SparkSession, vocabulary: Vocabulary) -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256: each text is encoded, its ids decoded, and both hashed.

    Ids stay in the worker; only the digests travel.
    """
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = shared.value
        pre = _pretokens(v, lambda ids: (len(ids), " ".join(map(str, ids)), v.decode(ids)))
        for texts in it:
            rows = []
            for doc in pre.documents(texts.tolist()):
                ids, raw = " ".join([d[1] for d in doc]), b"".join([d[2] for d in doc])
                rows.append((sum([d[0] for d in doc]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text.cast("string"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", digests(F.col("text"), spark, Vocabulary()).alias("d")).select("doc_id", "d.*")
