"""Token counts under a unigram model, by dynamic programming on a trie of the distinct pre-tokens.

The sorted pre-tokens of a block form a trie: a node is a prefix that no earlier row has. Depth by
depth, every node takes its best forward score from its ancestors: over all pieces that end there,
the ancestor's score plus the piece's log-probability, ties to fewer pieces. A shared prefix is thus
scored once, and the node where a pre-token ends holds its count.

The piece table is a parameter. The default takes the pieces of a public byte-level vocabulary with
Zipf weights, log-probability ``-log(rank + 2)``; single bytes are pieces, so every text has a
segmentation.

Defined results: null and empty texts count 0 tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashtable import HashTable
from .kernels import Hasher, mix, utf8
from .pretokens import Pretokens

#: Longer pre-tokens are scored alone, byte by byte, since a row of the matrix would be mostly padding.
WIDTHS = (8, 16, 32, 128)


class Pieces:
    """Piece bytes with log-probabilities; every single byte must be among them."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        joined = np.frombuffer(b"".join(scores), np.uint8)
        ends = np.cumsum([len(p) for p in scores])
        hashed = Hasher(joined)
        keys = mix(hashed(np.r_[0, ends[:-1]], ends))
        self.table = HashTable(keys, np.arange(len(scores)))
        self.values = np.r_[np.fromiter(scores.values(), float), -np.inf]  # the last: no such piece

    @classmethod
    def zipf(cls, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> Pieces:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): -float(np.log(int(r) + 2)) for t, r in map(bytes.split, lines)})

    def counts(self, words: list[bytes]) -> list[int]:
        """Pieces in the best segmentation of each word."""
        out = [0] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            width = next((x for x in WIDTHS if len(w) <= x), 0)
            if width:
                groups.setdefault(width, []).append(i)
            else:
                out[i] = self._alone(w)
        for width, members in groups.items():
            members.sort(key=lambda i: words[i])
            for i, n in zip(members, self._trie([words[i] for i in members], width), strict=True):
                out[i] = n
        return out

    def _trie(self, words: list[bytes], width: int) -> list[int]:
        """``words`` are sorted."""
        n, lengths = len(words), np.array([len(w) for w in words])
        inside = np.arange(width) < lengths[:, None]
        grid = np.zeros((n, width), np.int16) - 1
        grid[inside] = np.frombuffer(b"".join(words), np.uint8)
        flat = np.zeros(n * width, np.uint8)
        flat[inside.ravel()] = grid[inside]
        hashed = Hasher(flat)
        same = np.zeros((n, width), bool)
        same[1:] = np.logical_and.accumulate(grid[1:] == grid[:-1], axis=1)
        score, count = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
        score[:, 0] = 0
        # the row that owns the node of each depth: the first row with that prefix
        owner = np.zeros((n, width + 1), np.int64)
        owner[:, 1:] = np.maximum.accumulate(np.where(same, 0, np.arange(n)[:, None]), axis=0)
        for depth in range(1, width + 1):
            new = np.flatnonzero(inside[:, depth - 1] & ~same[:, depth - 1])
            base = new * width
            for size in range(1, min(depth, self.longest) + 1):
                start = depth - size
                piece = self.table.get(mix(hashed(base + start, base + depth)), len(self.values) - 1)
                at = owner[new, start]
                value, pieces = score[at, start] + self.values[piece], count[at, start] + 1
                old = score[new, depth]
                better = (value > old) | ((value == old) & (pieces < count[new, depth]) & (value > -np.inf))
                score[new[better], depth], count[new[better], depth] = value[better], pieces[better]
        return count[owner[np.arange(n), lengths], lengths].tolist()

    def _alone(self, word: bytes) -> int:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = (-np.inf, 0)
            for size in range(1, min(end, self.longest) + 1):
                p = self.scores.get(word[end - size : end])
                if p is not None:
                    s, n = best[end - size]
                    if s + p > found[0] or (s + p == found[0] and n + 1 < found[1]):
                        found = (s + p, n + 1)
            best.append(found)
        return best[-1][1]


def count_tokens(docs: DataFrame, pieces: Pieces, text: str = "text", out: str = "n_tokens", pretokens_out: str = "n_pretokens") -> DataFrame:
    """``docs`` with the unigram tokens and the pre-tokens of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("tokens long, pre long")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = shared.value
        pre = Pretokens(public_tokenizers.PATTERN, lambda new: p.counts([utf8(t) for t in new]))
        for texts in it:
            yield pd.DataFrame([(sum(doc), len(doc)) for doc in pre.documents(texts.tolist())], columns=["tokens", "pre"])

    held = docs.withColumn("__n", count(F.col(text).cast("string")))
    return held.withColumns({out: F.col("__n.tokens"), pretokens_out: F.col("__n.pre")}).drop("__n")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, Pieces.zipf()).select("doc_id", "n_tokens", "n_pretokens")
