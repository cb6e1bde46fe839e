"""Shingle sets of texts, and the global order of shingles by how many sets hold them.

Words and shingles are hashed for many texts at once with NumPy. Each task gathers the distinct shingles of its sets in
blocks and sends every shingle once, to the range of hashes it belongs to; a range sums up how many sets hold each
shingle and answers the blocks about those that more than one set holds. What only one set holds needs no answer: it can't
be shared. Blocks, ranges and answers are bounded by parameters (and by one text), whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common
from lumigrid.llm.compact import packed, sorted_places, squeezed, stretched, unpacked

WORDS = 5
#: Two sets link when PER * intersection >= LEAST * union.
LEAST, PER = 75, 100
#: Shingles of a block; sets of a block (places are 16 bits); characters of text behind a range of hashes.
BLOCK, BLOCK_SETS, RANGE_CHARS = 1_000_000, 1 << 16, 8_000_000
#: Bytes of text that are hashed at once.
SLICE = 1 << 16
#: Bits of a set's parity map.
PARITY = 1024

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _factors(start: int, stop: int) -> np.ndarray:
    """Odd random numbers, one for each place of a letter in its word."""
    return _mixed(np.arange(start, stop, dtype=_U) + _U(0x9E3779B97F4A7C15)) | _U(1)


_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = _mixed(np.arange(1, 257, dtype=_U))
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_PLACE = _factors(0, 1 << 12)
_TURN = _factors(1 << 20, (1 << 20) + WORDS)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in data, beginning at starts: all words' hashes and bytes, and each text's first
    word (and the end of the last)."""
    letter = ~_BREAK[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    firsts = starts[starts < len(data)]
    begins[firsts] = letter[firsts]  # a word ends with its text
    at = np.cumsum(letter) - 1
    heads = np.flatnonzero(begins)
    if not len(heads):
        return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64), np.zeros(len(starts) + 1, dtype=np.int64)
    first = at[heads]
    sizes = np.diff(np.append(first, at[-1] + 1))
    place = np.arange(at[-1] + 1) - np.repeat(first, sizes)
    longest = int(sizes.max())
    factors = _PLACE if longest <= len(_PLACE) else _factors(0, longest)
    h = _mixed(np.add.reduceat(_LETTER[data[letter]] * factors[place], first))
    return h, sizes, np.append(np.searchsorted(heads, starts), len(h))


def _of_long(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and bytes of a long text's words, a slice at a time; slices end between words."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw) and not _BREAK[raw[end]]:
            end += 1
        out.append(word_hashes(np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at), np.zeros(1, dtype=np.int64))[:2])
        at = end
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _set_of(h: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text, from its words' hashes."""
    width = min(WORDS, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    s = np.full(n, width, dtype=_U)
    for k in range(width):
        s += h[k : k + n] * _TURN[k]  # word hashes are random already, and odd factors tell the places apart
    s = np.sort(_mixed(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of each text's lower-cased words, and how many bytes each word has."""
    some, size = [], 0

    def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.cumsum([0, *map(len, some)])[:-1]
        h, sizes, first = word_hashes(np.frombuffer(b"".join(some), dtype=np.uint8), starts)
        for a, z in zip(first[:-1], first[1:], strict=True):
            yield h[a:z], sizes[a:z]

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if size + len(raw) > SLICE and some:
            yield from done()
            some, size = [], 0
        if len(raw) > SLICE:
            yield _of_long(raw)
        else:
            some.append(raw)
            size += len(raw)
    if some:
        yield from done()


def sets_of(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    return (_set_of(h) for h, _ in hashed(texts))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A signed 128-bit hash of a set, in two halves."""
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (2**64 - 1)))


def parity(s: np.ndarray) -> list[int]:
    odd = (np.bincount((s & _U(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").tolist()


#: range: the upper bits of a hash. once, at: hashes that one set of the block holds, and its place in the block. many,
#: times: hashes that more of its sets hold, and how many. The rest is in a block's first row only: its documents with the
#: place of their set (null for none); its sets' sizes and keys; and what the sets hold of `many`, by hash.
PIECES = "range int, block long, once binary, at binary, many binary, times binary, ids array<long>, texts array<long>, places array<int>, sizes array<long>, highs array<long>, lows array<long>, held binary, held_at binary"
#: Answers: of once those that other sets hold too, with their place and how many sets hold them; of many the same.
ANSWERS = "range int, block long, once binary, at binary, sets binary, many binary, many_sets binary, ids array<long>, texts array<long>, places array<int>, sizes array<long>, highs array<long>, lows array<long>, held binary, held_at binary"
#: A row for each document (doc_id, text_key, and of its set the size n and the key high, low), and one for each set of a
#: block that shares enough: items are the shingles that others hold too, rare ones first, freqs how many sets hold them,
#: and bit b of parity says whether an odd number of items falls on b.
SETS = "doc_id long, text_key long, n long, high long, low long, items array<long>, freqs array<int>, parity array<long>"

_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[k]) for n, k in fields], names=[n for n, _ in fields])


def pieces(base: DataFrame, bits: int) -> DataFrame:
    """From (doc_id, text, text_key): the pieces of each block, by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def done(docs: list[tuple], sets: dict[tuple, np.ndarray]) -> pa.RecordBatch:
            values = list(sets.values())
            sizes = np.array([len(s) for s in values], dtype=np.int64)
            every, place = np.concatenate([np.empty(0, dtype=_U), *values]), np.repeat(np.arange(len(values)), sizes)
            every, order = sorted_places(every, 64)
            place = place[order].astype("<u2")
            new = np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]
            times = np.diff(np.append(np.flatnonzero(new), len(every)))
            single = np.repeat(times == 1, times)
            once, at = every[single], place[single]
            many, times = every[new][times > 1], times[times > 1]
            head = {"ids": [d[0] for d in docs], "texts": [d[1] for d in docs], "places": [d[2] for d in docs], "sizes": sizes.tolist(), "highs": [k[0] for k in sets], "lows": [k[1] for k in sets], "held": squeezed(every[~single], 0), "held_at": place[~single].tobytes()}
            step = 64 - bits
            cuts = [np.append(np.searchsorted(x, np.arange(1 << bits, dtype=_U) << _U(step)), len(x)) for x in (once, many)]
            rows = []
            for r in range(1 << bits):
                (a, z), (b, y) = ((c[r], c[r + 1]) for c in cuts)
                if z > a or y > b:
                    rows.append({"range": r, "block": block, "once": squeezed(once[a:z], r << step), "at": at[a:z].tobytes(), "many": squeezed(many[b:y], r << step), "times": packed(times[b:y])})
            if rows:
                rows[0] |= head
            else:
                rows.append({"range": 0, "block": block} | head)
            return _table(rows, PIECES)

        docs, sets, size = [], {}, 0
        for b in common.sliced(batches):
            for doc_id, key, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), sets_of(b.column(1).to_pylist()), strict=True):
                place = None
                if len(s):
                    name = set_key(s)
                    place = list_at[name] if sets and name in sets else len(sets)
                    if place == len(sets):
                        if not sets:
                            list_at = {}
                        sets[name], list_at[name] = s, place
                        size += len(s)
                docs.append((doc_id, key, place))
                if size >= BLOCK or len(sets) >= BLOCK_SETS or len(docs) >= 4 * BLOCK_SETS:
                    yield done(docs, sets)
                    block += 1
                    docs, sets, size = [], {}, 0
        if docs:
            yield done(docs, sets)

    return base.mapInArrow(run, PIECES)


def answers(found: DataFrame, bits: int) -> DataFrame:
    """What each range says to the blocks."""

    def one(whole: pa.Table) -> pa.Table:
        base = whole.column("range")[0].as_py() << (64 - bits)
        rows = whole.to_pylist()
        once = [stretched(r["once"], base) for r in rows]
        many = [stretched(r["many"], base) for r in rows]
        every = np.concatenate([*once, *many])
        weight = np.concatenate([np.ones(sum(map(len, once)), dtype=np.int64), *[unpacked(r["times"]) for r in rows]])
        sorted_, order = sorted_places(every - _U(base), 64 - bits)
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(every)]
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(weight[order], heads) if len(heads) else weight
        sets = np.empty(len(every), dtype=np.int64)
        sets[order] = np.repeat(sums, np.diff(np.append(heads, len(every))))
        sets = np.minimum(sets, 2**31 - 1)
        out, a, b = [], 0, sum(map(len, once))
        for r, x, y in zip(rows, once, many, strict=True):
            s, m = sets[a : a + len(x)], sets[b : b + len(y)]
            a, b = a + len(x), b + len(y)
            shared = s > 1
            at = np.frombuffer(r["at"] or b"", dtype="<u2")
            if shared.any() or len(y) or r["ids"] is not None:
                kept = {"range": r["range"], "block": r["block"], "once": squeezed(x[shared], base), "at": at[shared].tobytes(), "sets": packed(s[shared]), "many": squeezed(y, base), "many_sets": packed(m)}
                out.append(kept | {k: r[k] for k in ("ids", "texts", "places", "sizes", "highs", "lows", "held", "held_at")})
        return pa.Table.from_batches([_table(out, ANSWERS)])

    return found.groupBy("range").applyInArrow(one, ANSWERS)


def ordered(told: DataFrame, bits: int) -> DataFrame:
    """From the answers to each block: its documents, and its sets that share at least what a link takes."""

    def one(whole: pa.Table) -> pa.Table:
        rows = whole.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        base = [r["range"] << (64 - bits) for r in rows]
        many = np.concatenate([stretched(r["many"], b) for r, b in zip(rows, base, strict=True)])
        many_sets = np.concatenate([unpacked(r["many_sets"]) for r in rows])
        order = np.argsort(many)
        many, many_sets = many[order], many_sets[order]
        held, held_at = stretched(head["held"], 0), np.frombuffer(head["held_at"], dtype="<u2")
        item = np.concatenate([held, *[stretched(r["once"], b) for r, b in zip(rows, base, strict=True)]])
        place = np.concatenate([held_at, *[np.frombuffer(r["at"], dtype="<u2") for r in rows]]).astype(np.int64)
        freq = np.concatenate([many_sets[np.searchsorted(many, held)] if len(many) else many_sets, *[unpacked(r["sets"]) for r in rows]])
        n = np.array(head["sizes"], dtype=np.int64)
        enough = PER * np.bincount(place, minlength=len(n)) >= LEAST * n
        item, place, freq = (x[enough[place]] for x in (item, place, freq))
        order = np.lexsort((item, freq, place))
        item, place, freq = item[order].view(np.int64), place[order], freq[order].astype(np.int32)
        chosen = np.flatnonzero(enough)
        cuts = np.append(np.searchsorted(place, chosen), len(place)).astype(np.int32)
        names = [x.split()[0] for x in SETS.split(", ")]
        highs, lows, places = np.array(head["highs"], dtype=np.int64), np.array(head["lows"], dtype=np.int64), pa.array(head["places"], pa.int32())
        none = pa.nulls(len(chosen), pa.int64())
        odd = [parity(item[a:z].view(_U)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (item, freq)]
        sets = [none, none, pa.array(n[chosen]), pa.array(highs[chosen]), pa.array(lows[chosen]), *lists, pa.array(odd, pa.list_(pa.int64()))]
        empty = [pa.nulls(len(places), pa.list_(k)) for k in (pa.int64(), pa.int32(), pa.int64())]
        sizes = pa.array(n).take(places).fill_null(0) if len(n) else pa.array([0] * len(places), pa.int64())
        of = [pa.array(x).take(places) if len(x) else pa.nulls(len(places), pa.int64()) for x in (highs, lows)]
        docs = [pa.array(head["ids"], pa.int64()), pa.array(head["texts"], pa.int64()), sizes, *of, *empty]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=names) for x in (docs, sets)])

    return told.groupBy("block").applyInArrow(one, SETS)


def shared_sets(docs: DataFrame) -> DataFrame:
    """SETS of docs (doc_id, text), written to the shared folder."""
    base = common.corpus(docs).withColumn("text_key", F.xxhash64("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(20, max(6, (chars // RANGE_CHARS).bit_length()))
    return common.written(ordered(answers(pieces(base, bits), bits), bits), "shingle-sets")
