"""Gap-weighted subsequence kernel on words.

A word's features are all subsequences of three characters, each occurrence weighted by ``DECAY``
to the power of the span it stretches over; spans are limited to ``SPAN`` characters. The kernel of
two words is the product of their features. A character put between the letters of a word only
weakens some occurrences, so disguised spellings stay close.

Words are lower-cased and stand between the marks ``^`` and ``$``. Signs and digits take up room but
match nothing.
"""

from __future__ import annotations

import numpy as np

DECAY = 0.7
SPAN = 6
_SYMBOLS = 60
FEATURES = _SYMBOLS**3
MAX_CHARS = 26
_STRIDE = MAX_CHARS // 2
# Offsets of the second and third character, and the weight of the span.
_OFFSETS = [(i, j, DECAY ** (j + 1)) for j in range(2, SPAN) for i in range(1, j)]
_SIGNS = " \t\n\r\v\f!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def _symbol_table() -> np.ndarray:
    """Characters to symbols: a-z, then other letters on 31 symbols, then the two marks; 0 matches nothing."""
    table = np.zeros(0x3000, dtype=np.int32)
    for c in range(0x80, len(table)):
        if chr(c).isalpha():
            table[c] = 27 + c % 31
    table[97:123] = np.arange(1, 27)
    table[ord("^")], table[ord("$")] = 58, 59
    return table


_TABLE = _symbol_table()


def normal_form(word: str) -> str:
    """A lower-case word without signs at either end."""
    return word.strip(_SIGNS)


def pieces(form: str) -> list[str]:
    """A word between its marks, with inner signs also without them; a long one as overlapping pieces, so
    that no part of it is left out."""
    found = []
    for word in (form,) if form.isalpha() else (form, "".join(c for c in form if c.isalpha())):
        marked = f"^{word}$"
        stops = range(0, len(marked) - _STRIDE, _STRIDE) if len(marked) > MAX_CHARS else (0,)
        found.extend(marked[a : a + MAX_CHARS] for a in stops)
    return found


def occurrences(words: list[str]):
    """For each kind of span: ``(features, weight)``; features are a row of numbers per word. A number in which one
    of the three symbols is 0 is no feature."""
    width = max(map(len, words), default=0)
    raw = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), dtype="<u4")
    codes = _TABLE[np.where(raw < len(_TABLE), raw, 0)].reshape(len(words), width)
    first, second = codes * np.int32(_SYMBOLS**2), codes * np.int32(_SYMBOLS)
    for i, j, weight in _OFFSETS:
        if j < width:
            yield first[:, : width - j] + second[:, i : width - j + i] + codes[:, j:], weight


def _whole(features: np.ndarray) -> np.ndarray:
    """Which numbers have three symbols."""
    return (features >= _SYMBOLS**2) & (features // _SYMBOLS % _SYMBOLS > 0) & (features % _SYMBOLS > 0)


class Landmarks:
    """Words that others are compared with."""

    def __init__(self, words: list[str]):
        found = list(occurrences(words))
        used = np.unique(np.concatenate([f[_whole(f)] for f, _ in found]))
        self.words = words
        self._number = np.zeros(FEATURES, dtype=np.int32)
        self._number[used] = np.arange(1, len(used) + 1)
        dense = np.zeros((len(used) + 1, len(words)))
        for features, weight in found:
            number = self._number[features]
            word, at = np.nonzero(number)
            np.add.at(dense, (number[word, at], word), weight)
        self.self_products = (dense**2).sum(axis=0)
        norm = np.sqrt(self.self_products)
        self.gram = dense.T @ dense / norm / norm[:, None]
        # A feature's landmarks and values, as rows of different lengths.
        feature, self._landmark = np.nonzero(dense)
        self._value = dense[feature, self._landmark]
        self._first = np.searchsorted(feature, np.arange(len(used) + 2))

    def products(self, words: list[str], block: int = 1024) -> np.ndarray:
        """Kernel of each word with each landmark, over the landmark's kernel with itself: 1 if it is contained whole.

        Words of like length are handled together.
        """
        out = np.zeros((len(words), len(self.words)))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for a in range(0, len(words), block):
            some = order[a : a + block]
            cells, weights = [np.empty(0, dtype=np.int64)], [np.empty(0)]
            for features, weight in occurrences([words[k] for k in some]):
                number = self._number[features]
                word, at = np.nonzero(number)
                first = self._first[number[word, at]]
                count = self._first[number[word, at] + 1] - first
                entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                cells.append(np.repeat(word * len(self.words), count) + self._landmark[entry])
                weights.append(self._value[entry] * weight)
            own = np.bincount(np.concatenate(cells), np.concatenate(weights), len(some) * len(self.words))
            out[some] = own.reshape(len(some), -1)
        return np.minimum(out / self.self_products, 1.0)
