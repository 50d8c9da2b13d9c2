"""Words of whole texts as numpy arrays: positions and 64-bit hashes, a batch at a time.

A word is a run of bytes other than ASCII white space, so texts in any script stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, remembered up to the longest asked for so far."""
    if len(_powers.get(base, ())) < max(n, 1):
        power = np.full(max(n, 1 << 20), base, dtype=U64)
        power[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(power, out=power)
        _powers[base] = power
    return _powers[base][:n]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span: differences of one running polynomial."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * _power(_BASE, len(data)), out=total[1:])
        return mix((total[end] - total[start]) * _power(_UNBASE, len(data) + 1)[start])


_LONG_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)


def digest_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``hash_spans``, eight bytes at a time through the finaliser; long spans by BLAKE2b.

    A polynomial modulo a power of two gives some long spans of a regular build one value,
    whatever its base is. Here spans of one length up to eight bytes never meet at all.
    """
    size = end - start
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(U64), 1)
    at = np.flatnonzero(size > 0)
    for k in range(0, _LONG_SPAN, 8):
        if k:
            at = at[size[at] > k]
        if not len(at):
            break
        chunk = eight[start[at] + k] & _LOW_BYTES[np.minimum(size[at] - k, 8)]
        out[at] = mix(out[at] ^ chunk)
    for i in at[size[at] > _LONG_SPAN].tolist():
        span = data[start[i] : end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of several texts, one after another; ``first[i]:first[i + 1]`` are those of text i.

    ``start`` and ``end`` are byte positions in the UTF-8 of their own text.
    """

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes], hashing: Callable = hash_spans) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(size + 1)])
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(U64), none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    hashed = hashing(data, start, end)
    first = np.searchsorted(start, at)
    origin = np.repeat(at[:-1], np.diff(first))
    return Words(hashed, start - origin, end - origin, first)


def shingles_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``k`` words; a shorter text is one run of all it has."""
    n = len(words.hash)
    count = np.diff(words.first)
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(n) - np.repeat(words.first[:-1], count)
    left = np.repeat(count, count) - place  # words from here to the end of the text
    head = (left >= k) | (place == 0)
    at = np.flatnonzero(head)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), dtype=U64)
        for j in range(k):
            there = np.minimum(at + j, n - 1)
            word = np.where(left[at] > j, words.hash[there], U64(0))
            total = total * U64(0xD6E8FEB86659FD93) + word + U64(j + 1)
    return mix(total), owner[at]
