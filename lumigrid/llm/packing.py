"""Best-fit packing of token sequences by a configuration linear program.

Documents become token ids and are cut, if longer than a sequence, into pieces. All that the program needs is how many
pieces have each length: at most `size` numbers. A configuration is a multiset of lengths that fits in one sequence.
Multiplicative weights solve the covering program over configurations: each round prices the lengths, a knapsack
dynamic program finds the configuration of the greatest price, and the prices of what it covers sink, until all lengths
are covered and the solution is within GAP of its dual bound. The solution's full configurations are rounded down, and
what is left is packed best fit by descending length, again by whole configurations.

Spark does what grows with the data: it counts words into pieces, ranks the pieces within their length, and looks up
each rank in the table of configurations, whose rows are bounded by rounds and lengths.

Defined results: a null or empty text is one piece of length 1 (the end id); repeated rows are packed separately; an
empty table gives an empty result; a null id is kept.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common

SIZE, END_ID = 2048, 0
#: Words, and parts of words, whose ids a Python worker keeps at most; those that are encoded at once.
MAX_WORDS, AT_ONCE = 350_000, 20_000
#: The program ends this close to its lower bound; prices fall by exp(-RATE) until a length is covered.
GAP, RATE = 0.01, 2.0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A rule that cuts words into parts, which are encoded one by one after NFC and lower-casing; what a part's last id stands for ends with END.
RULE, END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: What plain words don't hold: they are of ASCII and of Latin-1's letters, which NFC leaves alone. Their parts by RULE once they are
#: lower-cased, which are kept for all words that have them, and the words of ASCII white space.
ODD = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]")
PARTS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
WORD = re.compile("[^\t-\r ]+")


def ends_of(path: str) -> np.ndarray | None:
    """Whether each id ends a part of a word; None for a tokenizer that doesn't go by RULE."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    kinds = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers", [])]
    cuts = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = cuts[0] if [x["type"] for x in cuts] == ["Split", "ByteLevel"] else {}
    model = held["model"]
    as_known = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": RULE} and split["behavior"] == "Removed" and split["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    if not as_known or model["type"] != "BPE" or model["end_of_word_suffix"] != END or any(model[k] for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return None
    if any(a["normalized"] or not a["content"].startswith("<|") for a in held["added_tokens"]):
        return None
    out = np.zeros(1 + max(model["vocab"].values()), dtype=bool)
    out[[i for token, i in model["vocab"].items() if token.endswith(END)]] = True
    return out


class Words:
    """Ids by part of a word, or by word. The tokenizer drops white space and never joins across it, so a text's ids are its words'
    ids. Plain words are made of parts, which repeat more often than words do and are encoded many at once: in one text, whose ids
    are cut where parts end."""

    kept: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.ends = Tokenizer.from_file(path), {}, ends_of(path)

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [self._cut(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.ids)
        if len(self.ids) + len(new) > MAX_WORDS:
            self.ids.clear()
            new = set(chain.from_iterable(split))
        parts = [w for w in new if self._plain(w)]
        for i in range(0, len(parts), AT_ONCE):
            self._add(parts[i : i + AT_ONCE])
        others = list(new.difference(parts))
        for i in range(0, len(others), AT_ONCE):
            some = others[i : i + AT_ONCE]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.ids[w] = array("I", e.ids).tobytes()
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _plain(self, text: str) -> bool:
        return self.ends is not None and "<|" not in text and not ODD.search(text)

    def _cut(self, text: str) -> list[str]:
        """The parts of a text's plain words, and its other words, in their order."""
        if self._plain(text):
            return PARTS.findall(text.lower())
        words = WORD.findall(text)
        if self.ends is None:
            return words
        return list(chain.from_iterable(PARTS.findall(w.lower()) if self._plain(w) else (w,) for w in words))

    def _add(self, parts: list[str]) -> None:
        got = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = 4 * (np.flatnonzero(self.ends[got]) + 1)
        if len(stops) != len(parts):
            raise ValueError("the tokenizer joins or drops parts of words")
        raw, a = got.tobytes(), 0
        for part, z in zip(parts, stops.tolist(), strict=True):
            self.ids[part] = raw[a:z]
            a = z


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    path = path or vocabulary_path()
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = []
                for doc_id, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, k, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)])) for k, s in enumerate(range(0, n, size))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return common.corpus(docs).mapInArrow(cut, PIECES)


def knapsack(prices: np.ndarray, size: int) -> list[int]:
    """The lengths of a configuration of the greatest total price, of equal ones the longest lengths; prices[l] is that of
    length l, 0 for none."""
    dense = np.full(size + 1, -np.inf)
    dense[: len(prices)] = np.where(prices > 0, prices, -np.inf)[: size + 1]
    falling = dense[::-1].copy()  # falling[size - l] is the price of length l
    best, last = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        ways = falling[size - c : size] + best[:c]  # lengths c, c - 1, ..., 1
        k = int(ways.argmax())
        if ways[k] > best[c - 1]:
            best[c], last[c] = ways[k], c - k
        else:
            best[c] = best[c - 1]
    out, c = [], size
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return sorted(out, reverse=True)


def cover(counts: np.ndarray, size: int, step: float, rate: float) -> tuple[list[tuple[list[int], float]], float]:
    """(configuration, how often) covering all pieces of each length l < size fractionally, and a lower bound on how often.

    A round gives its configuration the share step of what its scarcest length has left, but at least one sequence (or
    all that is left): lengths run out one after the other, and the rounds end when none is left."""
    have = counts.astype(float)
    have[size:] = 0
    natural = np.arange(len(have), dtype=float)  # whole numbers, so that ties are exact
    rest = have.copy()
    out, bound = [], 0.0
    while (rest > 0).any():
        open_ = rest > 0
        prices = np.where(open_, natural * np.exp(-rate * (1 - rest / np.maximum(have, 1))), 0.0)
        config = knapsack(prices, size)
        use = np.bincount(config, minlength=len(have))
        held = use > 0
        # prices over the value of the best configuration are a feasible dual
        bound = max(bound, float(prices @ have) / float(prices[held] @ use[held]))
        most = (rest[held] / use[held]).min()
        amount = max(min(most, 1.0), most * step)
        out.append((config, amount))
        rest[held] -= use[held] * amount
        rest[rest < 1e-9 * np.maximum(have, 1)] = 0
    return out, bound


def solve(counts: np.ndarray, size: int, gap: float = GAP, rate: float = RATE) -> tuple[list[tuple[list[int], float]], float]:
    """The covering program's solution and its lower bound: steps are halved until both are within gap, or no step helps."""
    best, bound, step = None, 0.0, 1.0
    while True:
        found, low = cover(counts, size, step, rate)
        bound = max(bound, low)
        before = math.inf if best is None else sum(a for _, a in best)
        now = sum(a for _, a in found)
        best = found if now < before else best
        if min(now, before) <= (1 + gap) * bound or now >= before:
            return best, bound
        step /= 2


def best_fit(left: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Packs all that is left, whole configurations at a time: the longest first, then the longest that still fits."""
    left, out = left.copy(), []
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:
        config, room, used = [], size, {}
        at = len(lengths)
        while at:
            at = bisect_right(lengths, room, 0, at)
            if not at:
                break
            x = lengths[at - 1]
            n = int(min(left[x], room // x))
            config += [x] * n
            used[x] = n
            room -= n * x
            at -= 1
        times = min(int(left[x]) // n for x, n in used.items())
        out.append((config, times))
        for x, n in used.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x]]
    return out


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """(configuration, times) that hold counts[l] pieces of each length l exactly."""
    counts = counts.astype(np.int64)
    left, rounded = counts.copy(), []
    if counts[size:].any():
        rounded.append(([size], int(counts[size])))
        left[size] = 0
    for config, amount in solve(left, size)[0]:
        use = np.bincount(config, minlength=len(left))
        times = int(min(amount + 1e-6, (left[use > 0] // use[use > 0]).min()))
        if times > 0 and sum(config) == size:  # what a sequence would waste is better packed with what rounding leaves
            rounded.append((config, times))
            left -= use * times
    return rounded + best_fit(left, size)  # what rounding down has left


def slots(configs: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces of it in a sequence, first sequence, first offset) of each run of ranks."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for config, times in configs:
        offset = 0
        for x in sorted(set(config), reverse=True):
            n, r = config.count(x), rank.get(x, 0)
            out.append((x, r, r + n * times, n, sequence, offset))
            rank[x] = r + n * times
            offset += n * x
        sequence += times
    return out


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with common.Scratch(docs.sparkSession) as scratch:
        spark = docs.sparkSession
        cut = common.written(pieces(docs, size, path), "pieces")
        counts = np.zeros(size + 1, dtype=np.int64)
        for r in cut.groupBy("length").count().collect():  # at most `size` rows
            counts[r["length"]] = r["count"]
        runs = spark.createDataFrame(slots(plan(counts, size)) if counts.any() else [], "run_length long, first long, stop long, per long, sequence long, place long")
        ranked = common.gapless_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "rank")
        inside = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
        along = F.col("rank") - F.col("first")
        # runs: at most rounds + lengths configurations of a few dozen lengths each, whatever the size of the corpus
        placed = ranked.join(F.broadcast(runs), inside).select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("sequence") + F.floor(along / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("place") + (along % F.col("per")) * F.col("length")).cast("long").alias("offset"),
        )
        return scratch.keep(common.written(placed, "packed"))
