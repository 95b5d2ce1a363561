"""Words of a text and their hashes, for the operators that count over them."""

from __future__ import annotations

import numpy as np

from labelflow.llm.common import WHITE

#: entries of a task's word table before it is emptied
TABLE_ROWS = 50_000
_SPACES = str.maketrans({c: " " for c in WHITE})


class WordHash(dict):
    """Word to a 64-bit hash."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= TABLE_ROWS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[str]:
    """Maximal runs of anything but ASCII white space (split() alone would also cut at other white space)."""
    return text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in text.translate(_SPACES).split(" ") if w]


def word_hashes(words: list[str], table: WordHash) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash per window of k words, in order."""
    m = len(h) - k + 1
    s = np.full(max(m, 0), k, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i: m + i]
    return mix(s)
