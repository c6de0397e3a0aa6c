"""SHA-256 whose state can be kept and resumed, for many messages at once.

Messages are whole blocks: hex digests of 64 characters. After each of them the
state is eight words, which can be stored and gone on from later.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= x else (low, middle - 1)
    return low


# By the standard: the first 32 bits of the fractions of roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
# Four hex digits as one big-endian word, by the 16 bits that they write.
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_QUADS = np.arange(1 << 16)
_HEX = sum(_DIGITS[(_QUADS >> 4 * i) & 15] << np.uint32(8 * i) for i in range(4)).astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block (n, 16) each."""
    w = list(np.ascontiguousarray(block.T))
    a, b, c, d, e, f, g, h = first = list(np.ascontiguousarray(state.T))
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            s0 = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
            s1 = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            w.append(w[i - 16] + s0 + w[i - 7] + s1)
        t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
    return np.stack([x + y for x, y in zip(first, (a, b, c, d, e, f, g, h))], axis=1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the block of their hex text (n, 16)."""
    return np.stack([_HEX[digest >> np.uint32(16)], _HEX[digest & np.uint32(0xFFFF)]], axis=2).reshape(len(digest), 16)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages that ended after ``blocks`` (n) blocks."""
    pad = np.zeros((len(state), 16), np.uint32)
    pad[:, 0] = 1 << 31
    bits = blocks.astype(np.uint64) << np.uint64(9)
    pad[:, 14], pad[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(state, pad)


def to_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).astype(np.uint32)


def to_bytes(words: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in words.astype(">u4")]
