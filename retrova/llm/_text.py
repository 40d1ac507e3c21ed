"""Vectorised word splitting and hashing over Arrow string buffers.

Everything works on the UTF-8 bytes of a block of documents at once, so the cost per byte is a few NumPy passes and the
memory is bounded by the block (about BLOCK bytes, or one document where a single one is longer). Of a long document only its
words (24 bytes each) and its shingles are held whole; all else is done WINDOW bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Bytes of a block that are worked on at once: what a byte needs besides words and spans doesn't grow with a text.
WINDOW = 1 << 20
#: Bytes that are hashed at once: their sums stay in a core's cache, and take a few megabytes a worker.
HASHED = 1 << 17
U = np.uint64

#: ASCII A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as runs of anything but space, tab, LF, VT, FF and CR.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words as runs of a-z, 0-9 and every non-ASCII character (after LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(12, int(n).bit_length())
        steps = np.full(size + 1, base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Texts(NamedTuple):
    """UTF-8 bytes of some texts, one after the other; text i is data[offsets[i]:offsets[i + 1]], empty where null."""

    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    if pa.types.is_null(column.type):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0))


def blocks(texts: Texts, size: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive runs [i, j) of texts of about `size` bytes."""
    i, n = 0, len(texts.offsets) - 1
    while i < n:
        j = int(np.searchsorted(texts.offsets, texts.offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        a, b = texts.offsets[i], texts.offsets[j]
        yield i, j, Texts(texts.data[a:b], texts.offsets[i : j + 1] - a)
        i = j


class Words(NamedTuple):
    """Words of a block: byte spans in the block, hashes, and first[i] = index of the first word of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, broken at the offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    left = np.empty(n, bool)
    left[0] = True
    np.logical_not(inside[:-1], out=left[1:])
    right = np.empty(n, bool)
    right[-1] = True
    np.logical_not(inside[1:], out=right[:-1])
    return np.flatnonzero(inside & (left | edge[:-1])), np.flatnonzero(inside & (right | edge[1:])) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, mixed with its length.

    The spans are sorted and don't overlap. Sums run over HASHED bytes at a time, so nothing but the spans grows with the data;
    the few spans that cross an edge are summed in pieces.
    """
    h = np.empty(len(start), U)
    at = np.arange(0, len(data) + 1, HASHED)
    for low, i, j in zip(at.tolist(), np.searchsorted(start, at).tolist(), np.searchsorted(start, at + HASHED).tolist(), strict=True):
        if i == j:
            continue
        cut = min(low + HASHED, len(data))
        total = np.zeros(cut - low + 1, U)
        np.cumsum((data[low:cut].astype(U) + U(1)) * _power(_BASE, HASHED)[: cut - low], out=total[1:])
        a, b = start[i:j] - low, np.minimum(end[i:j], cut) - low
        h[i:j] = (total[b] - total[a]) * _power(_BASE_INVERSE, HASHED)[a]
        for p in range(cut, int(end[j - 1]), HASHED):  # the last span may go on
            piece = data[p : min(p + HASHED, int(end[j - 1]))].astype(U) + U(1)
            far = pow(int(_BASE), p - int(start[j - 1]), 1 << 64)
            h[j - 1 : j] += (piece * _power(_BASE, HASHED)[: len(piece)]).sum(dtype=U, keepdims=True) * U(far)
    return mix(h + (end - start).astype(U) * U(0xA0761D6478BD642F))


def windows(inside: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of about WINDOW bytes of a block; none parts a run of bytes for which `inside` holds."""
    a, n = 0, len(data)
    while a < n:
        b, step = a + WINDOW, 1 << 12
        while b < n and inside[data[b - 1]]:
            at = np.flatnonzero(~inside[data[b : b + step]])
            b = b + int(at[0]) + 1 if len(at) else min(n, b + step)
            step *= 2
        b = min(b, n)
        yield a, b
        a = b


def words_of(texts: Texts, kind: np.ndarray) -> Words:
    parts = []
    for a, b in windows(kind[LOWER], texts.data):
        data = LOWER[texts.data[a:b]]
        edge = texts.offsets[np.searchsorted(texts.offsets, a) : np.searchsorted(texts.offsets, b, "right")] - a
        start, end = spans_of(kind[data], edge)
        parts.append((start + a, end + a, hash_spans(data, start, end)))
    start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))
    return Words(start, end, h, np.searchsorted(start, texts.offsets))


def shingles_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and first[i] = index of text i's first; a text of fewer words, but not none, has one of all."""
    count = np.diff(words.first)
    h = words.hash
    number = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(first[-1], U)
    if len(h) >= k:
        run = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            run = (run + h[j : len(h) - k + 1 + j]) * U(0xFF51AFD7ED558CCD)
            run ^= run >> U(29)
        long = count >= k
        take = np.repeat(words.first[:-1][long] - first[:-1][long], number[long]) + np.flatnonzero(np.repeat(long, number))
        out[np.repeat(long, number)] = mix(run[take])
    for i in np.flatnonzero((count > 0) & (count < k)):
        x = np.array([count[i]], U)
        for w in h[words.first[i] : words.first[i + 1]]:
            x = (x ^ w) * U(0xC4CEB9FE1A85EC53)
            x ^= x >> U(29)
        out[first[i]] = mix(x)[0]
    return out, first
