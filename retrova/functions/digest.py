"""The first 32 bits of MD5 for many texts at once, in numpy: a head and a tail of two lists, every head with every tail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The constants of the algorithm (fixed values).
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [x for own in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in own * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
#: Texts that are digested at a time: their states stay in a core's cache.
TILE = 16_384


def _mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if i < 16:
        np.bitwise_xor(c, d, out=out)
        out &= b
        out ^= d
    elif i < 32:
        np.bitwise_xor(b, c, out=out)
        out &= d
        out ^= c
    elif i < 48:
        np.bitwise_xor(b, c, out=out)
        out ^= d
    else:
        np.invert(d, out=out)
        out |= b
        out ^= c


def by_length(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, their bytes as a matrix) of the texts of each length."""
    size = np.array([len(t) for t in texts], np.int64)
    same = [np.flatnonzero(size == n) for n in np.unique(size)]
    return [(at, np.frombuffer(b"".join(texts[n] for n in at), np.uint8).reshape(len(at), -1) if size[at[0]] else np.zeros((len(at), 0), np.uint8)) for at in same]


def first_bits(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """A matrix of the first 32 bits of the MD5 of each head, one a row, followed by each tail, one a column."""
    (rows, before), (columns, after) = heads.shape, tails.shape
    n = before + after
    blocks = (n + 8) // 64 + 1
    right = np.zeros((columns, 64 * blocks), np.uint8)
    right[:, before:n], right[:, n] = tails, 0x80
    right[:, -8:] = np.frombuffer((8 * n).to_bytes(8, "little"), np.uint8)
    left = np.zeros((rows, -(-before // 4) * 4), np.uint8)
    left[:, :before] = heads
    words = [w[None, :] for w in np.ascontiguousarray(right.view("<u4").T)]
    for at, w in enumerate(np.ascontiguousarray(left.view("<u4").T)):
        words[at] = w[:, None] | words[at]
    state = [np.full((rows, columns), x, np.uint32) for x in _START]
    mixed = np.empty((rows, columns), np.uint32)
    for block in range(blocks):
        a, b, c, d = (x.copy() for x in state)
        own = words[16 * block : 16 * block + 16]
        for i in range(64):
            _mix(i, b, c, d, mixed)
            mixed += a
            mixed += own[_WORD[i]] + np.uint32(_SINES[i])
            np.left_shift(mixed, _TURNS[i], out=a)
            mixed >>= 32 - _TURNS[i]
            a |= mixed
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    return state[0].byteswap()  # the digest begins with the lowest byte


def tiles(heads: list[bytes], tails: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the heads, places of the tails, their first bits) until every head was with every tail."""
    lefts = by_length(heads)
    for at, right in by_length(tails):
        for low in range(0, len(at), 1_024):
            part = right[low : low + 1_024]
            step = max(1, TILE // len(part))
            for own, left in lefts:
                for begin in range(0, len(own), step):
                    yield own[begin : begin + step], at[low : low + 1_024], first_bits(left[begin : begin + step], part)
