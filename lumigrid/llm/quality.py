"""Quality rules by distribution divergence.

Each text becomes two histograms: of character classes and of a language's common words. The references are the sums
of these over all documents of a language, and even blends of two languages for texts that mix them. A document is kept
while the mean Jensen-Shannon distance of both to the nearest reference that has its language (of a language without a
reference: to the nearest of all) stays within a threshold. Texts
under MIN_WORDS words say too little about their distribution, so only the base rules judge them.

The texts are read once; counts and histograms are written as a narrow table, from which references are summed (by Spark)
and distances are computed in Arrow batches.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged alike; an empty
table gives an empty result; a null language is compared with every reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common

#: Common words by language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wird",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws.split()})
CLASSES = ("lower", "upper", "accented", "digit", "break", "punctuation", "symbol", "other")
SYMBOLS = "#*$%&|<>"
#: Under so many words, only the base rules judge. A text of n words may be MAX_DISTANCE + CHANCE / sqrt(n) away:
#: short texts differ from the reference by chance.
MIN_WORDS = 40
MAX_DISTANCE, CHANCE = 0.20, 0.6
MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, words array<int>"
WINDOW = 5


def _table() -> np.ndarray:
    """Character class by code point below 0x250; above, letters count as accented and the rest as other."""
    out = np.full(0x250, CLASSES.index("other"), dtype=np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if ch in " \t\n\x0b\x0c\r":
            kind = "break"
        elif ch in SYMBOLS:
            kind = "symbol"
        elif c < 128 and ch.islower():
            kind = "lower"
        elif c < 128 and ch.isupper():
            kind = "upper"
        elif ch.isalpha():
            kind = "accented"
        elif ch.isdigit():
            kind = "digit"
        elif 32 < c < 127:
            kind = "punctuation"
        else:
            kind = "other"
        out[c] = CLASSES.index(kind)
    return out


class Measurer:
    def __init__(self):
        self.table = _table()
        forms = {hash(f.encode()): i for i, w in enumerate(VOCABULARY) for f in (w, w.capitalize(), w.upper())}
        self.keys = np.array(sorted(forms), dtype=np.int64)
        self.slots = np.array([forms[k] for k in sorted(forms)])
        rng = np.random.default_rng(5)
        self.odd = rng.integers(1, 2**62, WINDOW, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def repeated(self, h: np.ndarray) -> int:
        """Words within 5-word windows that occur twice or more, from the words' hashes."""
        n = len(h) - WINDOW + 1
        if n < 2:
            return 0
        u = h.view(np.uint64)
        w = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            x = u[k : k + n] * self.odd[k]
            w += x ^ (x >> np.uint64(29))
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(n, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, np.flatnonzero(twice), 1)
        np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())

    def measure(self, text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = points < len(self.table)
        chars = np.bincount(self.table[points[low]], minlength=len(CLASSES))
        for c, times in zip(*np.unique(points[~low], return_counts=True), strict=True):
            chars[CLASSES.index("accented" if chr(c).isalpha() else "other")] += times
        h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        common_words = np.bincount(self.slots[at[hit]], minlength=len(VOCABULARY) + 1)
        common_words[-1] = len(h) - hit.sum()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        breaks = int(chars[CLASSES.index("break")])
        return len(words), len(points) - breaks, int(chars[CLASSES.index("symbol")]), len(lines) - len(set(lines)), self.repeated(h), chars.tolist(), common_words.tolist()


def measures(docs: DataFrame) -> DataFrame:
    """Counts and histograms of docs (doc_id, text, lang)."""
    common.bounded(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measurer()
        for b in common.sliced(batches):
            rows = [m.measure(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.list_(pa.int32())) for c in cols[5:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in MEASURES.split(", ")])

    return base.mapInArrow(run, MEASURES)


def references(measured: DataFrame) -> DataFrame:
    """(lang, chars array<double>, words array<double>): shares over all documents of each language with a word list."""
    known = measured.where(F.col("lang").isin(*COMMON))
    sums = [F.sum(F.col(c)[i]).cast("double") for c, n in (("chars", len(CLASSES)), ("words", len(VOCABULARY) + 1)) for i in range(n)]
    k = len(CLASSES)
    return known.groupBy("lang").agg(F.array(*sums[:k]).alias("chars"), F.array(*sums[k:]).alias("words")).select("lang", _shares(F.col("chars")).alias("chars"), _shares(F.col("words")).alias("words"))


def blends(refs: list) -> list[tuple[set[str], np.ndarray, np.ndarray]]:
    """(languages, character shares, word shares) of the references and of the even blends of each two."""
    rows = [(r["lang"], np.array(r["chars"]), np.array(r["words"])) for r in refs]
    return [({a, b}, (pa_ + pb) / 2, (wa + wb) / 2) for i, (a, pa_, wa) in enumerate(rows) for b, pb, wb in rows[i:]]


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, from 0 to 1, of rows of shares p from shares q."""
    mean = (p + q) / 2

    def half(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / mean), 0.0).sum(axis=-1)

    return np.sqrt(np.maximum(0.0, (half(p) + half(np.broadcast_to(q, p.shape))) / 2))


def nearest(measured: DataFrame, refs: list[tuple[set[str], np.ndarray, np.ndarray]]) -> DataFrame:
    """measured with distance: to the nearest of refs that has the language, or of all if none has; null without refs."""
    out = [x for x in MEASURES.split(", ")[:7]] + ["distance double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set().union(*[langs for langs, _, _ in refs]) if refs else set()
        for b in batches:
            shares = []
            for k in (7, 8):
                x = b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                shares.append(x / np.maximum(x.sum(axis=1, keepdims=True), 1.0))
            lang = np.array([x if x in known else "" for x in b.column(1).to_pylist()], dtype=object)
            best = np.full(b.num_rows, np.inf)
            for langs, chars, words in refs:
                rows = np.flatnonzero(np.isin(lang, [*langs, ""]))
                if len(rows):
                    best[rows] = np.minimum(best[rows], (distance(shares[0][rows], chars) + distance(shares[1][rows], words)) / 2)
            far = pa.array(best, mask=~np.isfinite(best))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], far], names=[x.split()[0] for x in out])

    return measured.mapInArrow(run, ", ".join(out))


def judged(docs: DataFrame, most: float = MAX_DISTANCE, chance: float = CHANCE, least_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document: counts, base_failed, distance (null under the minimum length) and kept."""
    with common.Scratch(docs.sparkSession) as scratch:
        measured = common.written(measures(docs), "quality-measures")
        refs = blends(references(measured).orderBy("lang").collect())  # at most a row per word list
        df = nearest(measured, refs).withColumn("distance", F.when(F.col("n_words") >= least_words, F.col("distance")))
        failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        kept = F.when(failed, F.lit(False)).otherwise(F.coalesce(F.col("distance") <= most + chance / F.sqrt("n_words"), F.lit(True)))
        return scratch.keep(common.written(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "distance"), "verdicts"))
