"""Numpy kernels shared by the text operators: byte segments, word boundaries, position-free hashes.

A 64-bit polynomial hash over prefix sums gives the hash of any byte range in O(1) without a
Python loop: with odd base B, ``sum(byte[i] * B**i)`` over [s, e) times ``B**-s`` (mod 2**64) does
not depend on where the range stands, so equal words hash alike in every block and on every executor.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that a kernel takes at once; bounds a worker's memory whatever the batch holds.
SEGMENT_BYTES = 1 << 20

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        _pow = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
        _inv = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _INV, np.uint64)])
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Hasher:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def segments(texts, separator: np.ndarray, limit: int = SEGMENT_BYTES):
    """Yield (doc indexes, byte buffer, end offset of each piece) with every piece closed by a separator.

    A text longer than ``limit`` is cut behind a separator byte, so no word is ever split; its pieces
    carry the same doc index in order. Null texts count as empty.
    """
    ids: list[int] = []
    parts: list[bytes] = []
    held = 0
    sep = bytes([int(np.flatnonzero(separator)[0])])

    def flush():
        joined = b"".join(parts)
        return np.array(ids, np.int64), np.frombuffer(joined, np.uint8), np.cumsum([len(p) for p in parts])

    for i, text in enumerate(texts):
        raw, at = utf8(text) + sep, 0
        while at < len(raw):
            end = len(raw)
            if end - at > limit:
                view = np.frombuffer(raw, np.uint8)
                cut = np.flatnonzero(separator[view[at : at + limit]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    for lo in range(at + limit, len(raw), limit):
                        later = np.flatnonzero(separator[view[lo : lo + limit]])
                        if len(later):
                            end = lo + int(later[0]) + 1
                            break
            if held and held + end - at > limit:
                yield flush()
                ids, parts, held = [], [], 0
            ids.append(i)
            parts.append(raw[at:end])
            held += end - at
            at = end
    if parts:
        yield flush()


def words(buf: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are no separators."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separator[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def table_of(characters) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = table_of([0x20, *range(0x09, 0x0E)])
#: All ASCII bytes but letters and digits; bytes of other characters count as letters.
NO_LETTER = table_of([c for c in range(128) if not chr(c).isalnum()])
#: A-Z to a-z, the rest unchanged.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
