"""A probabilistic suffix tree over the bytes of words, for words that a vocabulary doesn't hold.

A word is the sequence of its lower-cased bytes and its end, both ends being the byte 32, which no word has. Contexts are up
to two bytes before a byte, the word's start among them. A context is retained if the summed logarithms of its next bytes'
probabilities, each predicted without its own occurrence, exceed by MIN_DIVERGENCE those that its longest retained suffix
gives. A context's distribution is smoothed towards that suffix's by as many occurrences as it has different next bytes, and
the root's towards equal odds for all 256.

The tree has at most 256 ** 3 entries (128 ** 3 for plain letters) whatever the corpus, so each task may hold it.

Defined results: without words all bytes have equal odds; the empty word is its end alone; words of any length are whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: A context's least gain over its suffix, in nats.
MIN_DIVERGENCE = 4.0
GRAMS = "gram int, n long"
END = 0x20
#: Grams are numbers: the bytes, behind how many there are.
ONE, TWO, THREE = 1 << 24, 2 << 24, 3 << 24

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[END, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def letters_of(text: str) -> np.ndarray:
    """The lower-cased bytes of a text's words, one word after the other."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _LOWER[raw[~_BREAK[raw]]]


def _steps(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of all words and each word's end: the byte, the two before it in one number, and its place in the word."""
    wide = sizes + 1
    ends = np.cumsum(wide) - 1
    s = np.full(int(wide.sum()) + 2, END, dtype=np.int64)
    inside = np.ones(len(s) - 2, dtype=bool)
    inside[ends] = False
    s[2:][inside] = raw
    return s[2:], s[:-2] << 8 | s[1:-1], np.arange(len(s) - 2) - np.repeat(ends + 1 - wide, wide)


def grams_of(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of one to three bytes of words, and how many there are of each."""
    s, before, place = _steps(raw, sizes)
    return np.unique(np.concatenate([ONE | s, TWO | (before & 255) << 8 | s, (THREE | before << 8 | s)[place > 0]]), return_counts=True)


class Spelling:
    def __init__(self, grams: np.ndarray, n: np.ndarray):
        """From sorted grams and their counts."""
        parts = np.searchsorted(grams, [ONE, TWO, THREE, THREE + (1 << 24)])
        (g1, n1), (g2, n2), (g3, n3) = [((grams[a:z] & (ONE - 1)).astype(np.int64), n[a:z].astype(np.float64)) for a, z in zip(parts[:-1], parts[1:], strict=True)]
        count = np.zeros(256)
        count[g1] = n1
        kinds = max(1, len(g1))
        self.root = (count + kinds / 256) / (count.sum() + kinds)
        self.one = np.tile(self.root, (256, 1))
        total, other, kept = self._retained(g2, n2, self.root[g2 & 255], 1 << 8)
        count = np.zeros((256, 256))
        count[g2 >> 8, g2 & 255] = n2
        self.one[kept] = (count[kept] + other[kept, None] * self.root) / (total + other)[kept, None]
        self.total, self.other, self.kept = self._retained(g3, n3, self.one[g3 >> 8 & 255, g3 & 255], 1 << 16)
        use = self.kept[g3 >> 8]
        self.grams, self.counts = g3[use].astype(np.uint32), n3[use]

    @staticmethod
    def _retained(grams: np.ndarray, n: np.ndarray, suffix: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context its occurrences, its different next bytes, and whether it is retained."""
        of = grams >> 8
        total, other = np.bincount(of, weights=n, minlength=contexts), np.bincount(of, minlength=contexts).astype(np.float64)
        gain = n * np.log((n - 1 + other[of] * suffix) / (total[of] - 1 + other[of]) / suffix)
        return total, other, np.bincount(of, weights=gain, minlength=contexts) >= MIN_DIVERGENCE

    @classmethod
    def learnt(cls, grams: DataFrame) -> Spelling:
        """From GRAMS, at most 256 ** 3 and a few."""
        table = grams.toArrow().sort_by("gram")
        return cls(table.column("gram").to_numpy().astype(np.int64), table.column("n").to_numpy())

    def logs(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The natural logarithm of each word's probability, from all words' bytes and how many each has."""
        if not len(sizes):
            return np.empty(0)
        s, before, place = _steps(raw, sizes)
        p = self.one[before & 255, s]
        at = np.flatnonzero(self.kept[before] & (place > 0))
        grams = (before[at] << 8 | s[at]).astype(np.uint32)
        where = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        n = np.where(self.grams[where] == grams, self.counts[where], 0.0) if len(at) else np.empty(0)
        p[at] = (n + self.other[before[at]] * p[at]) / (self.total + self.other)[before[at]]
        return np.add.reduceat(np.log(p), np.cumsum(sizes + 1) - sizes - 1)
