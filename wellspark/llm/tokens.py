"""Token ids of whole texts, by a vocabulary file of the ``tokenizers`` library.

Natural text repeats its words, so a distinct word is encoded by the library once and its ids are
kept in a bounded table per worker; a text is the concatenation of its words' ids. That holds because the vocabulary's own rules split a text at white space and between
letters, digits and other signs, and never merge across such a border. Texts with characters
whose class could be judged differently here than in the library (controls, scripts beyond
Latin, the vocabulary's special strings) are encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "word_bpe_49k.json"
_CACHE_WORDS = 120_000  # in each of two generations
_ENCODED_AT_ONCE = 2_000
ENCODE_ROWS = 512  # texts handed to the encoder at a time
_WORD_END = "</w>"
_FRACTIONS = "²³¹¼½¾"
# The vocabulary's own splitting rule, written for this module's plain texts.
_PARTS = re.compile(rf"[^\W\d_{_FRACTIONS}]+|'(?:[stmd]|re|ve|ll)|[\d{_FRACTIONS}]|(?:[^\w\s]|_)+")
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-\u012f\u0131-\u024f\u2010-\u2027\u20ac]*\Z")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary file; an absolute path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian ids of ``width`` bytes (two where the vocabulary allows it)."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(vocabulary_path(vocabulary))
        vocabulary_ids = self._library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if len(vocabulary_ids) <= 1 << 16 else "<u4")
        self._by_words = os.path.basename(vocabulary) == DEFAULT_VOCABULARY
        self._ends = np.zeros(max(vocabulary_ids.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary_ids.items() if token.endswith(_WORD_END)]] = True
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype) for e in encoded]

    def _learn(self, words: list[str]) -> None:
        """Encodes words side by side; the last id of each of a word's parts is one that ends a part."""
        width = self.dtype.itemsize
        for at in range(0, len(words), _ENCODED_AT_ONCE):
            some = words[at : at + _ENCODED_AT_ONCE]
            parts = np.cumsum([len(_PARTS.findall(w)) for w in some])
            ids = self._library_ids([" ".join(some)])[0]
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != parts[-1]:
                raise ValueError("the vocabulary does not end every part of a word with a mark")
            ends = (ends[parts - 1] * width).tolist()
            data = ids.tobytes()
            self._known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)]))

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; known ones stay in the younger generation of the table."""
        if len(self._known) > _CACHE_WORDS:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        fresh = [w for w in words if w not in known]
        if older:
            known.update((w, older[w]) for w in fresh if w in older)
            fresh = [w for w in fresh if w not in known]
        self._learn(fresh)
        return list(map(known.__getitem__, words))

    def _by_distinct_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts: distinct words are looked up, then put in the order of the texts."""
        lists = pc.utf8_split_whitespace(pa.array(texts, type=pa.string()))
        coded = lists.values.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")
        data = self._word_ids(distinct[0].as_py().split(" "))
        pool = np.frombuffer(b"".join(data), dtype=self.dtype)
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        stops = np.cumsum(sizes[index])
        shift = starts[index] - (stops - sizes[index])
        ids = pool[np.repeat(shift, sizes[index]) + np.arange(stops[-1])]
        borders = np.append(0, stops)[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; null is the empty text."""
        found = [np.empty(0, dtype=self.dtype)] * len(texts)
        plain: dict[int, str] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._by_words and "<|" not in text and _PLAIN.match(text):
                form = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().strip()
                if form:
                    plain[i] = form
            else:
                found[i] = self._library_ids([text])[0]
        if plain:
            for i, ids in zip(plain, self._by_distinct_words(list(plain.values()))):
                found[i] = ids
        return found


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
