"""Vectorised 64-bit hashes of words and of runs of words, the same in every process.

Texts are handled as UTF-8 bytes; a word is a maximal run of bytes other than space and the five
ASCII control separators. All hashes are of whole words; two different runs of words share a hash
with a chance of about 2^-56.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C13)
_BASE = 0xD1342543DE82EF93  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = np.ones((2, 1), dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base and of its inverse up to ``n``."""
    global _powers
    while _powers.shape[1] < n:
        size = _powers.shape[1]
        ahead = np.array([[pow(_BASE, size, 1 << 64)], [pow(_INVERSE, size, 1 << 64)]], dtype=np.uint64)
        _powers = np.concatenate((_powers, _powers * ahead), axis=1)
    return _powers


def word_borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    apart = _SEPARATOR[data]
    change = np.flatnonzero(np.diff(np.concatenate(([True], apart)).view(np.int8)))
    if len(data) and not apart[-1]:
        change = np.append(change, len(data))
    return change[0::2], change[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a space after each, and where each begins (one more at the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    return data, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word."""
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the first word's number of each text (one more at the end)."""
    data, borders = joined(texts)
    starts, ends = word_borders(data)
    return hashes_of(data, starts, ends), np.searchsorted(starts, borders)


def runs_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of every run of ``words`` words, by its first word; runs that reach past the end are left out."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(words):
        total *= np.uint64(_BASE)
        total += hashes[j : j + n]
    return mix(total)
