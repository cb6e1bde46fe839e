"""Language-model scores from a probabilistic suffix tree over words.

A text is the sequence of its lower-cased words and one end. The tree's nodes are contexts of up to DEPTH preceding words
of the text. A context of the training documents is retained if it occurs LEAST times and diverges from its longest proper
suffix: the summed logarithms of its next words' probabilities, each predicted without its own occurrence, exceed those
that the suffix gives by MIN_DIVERGENCE. Each word is scored by the longest retained suffix of the text before it, whose
distribution is smoothed towards that of its own longest retained suffix, and so on up to the root: single words' shares
of all tokens, and for what these escape (Witten-Bell) the spelling.

The spelling is a second tree, over the bytes of a word and its end (`llm/spelling.py`). It learns from the words that the
training documents hold once, which are the likest to those that they don't hold at all.

The tree grows with the corpus and is never in one place. Blocks of documents are written once, as word numbers, and
bucketed by block. Each block sends its distinct words and n-grams, as sorted hashes with their counts, to ranges of
hashes, which sum them up and answer in the same order; then it sends for each context what its occurrences gain, and
learns which contexts are retained. A word that is seen once is in one block, which counts its letters. So a frequent word or context takes one entry a block, and only hashes, counts and
gains are shuffled; blocks stay where they are. n-grams of two and more words are hashed to SPARE bits more than
their number needs: about one in 2 ** SPARE shares its hash with another one.

Defined results: a null or empty text is its end token alone; a row with a null id is not held out (it is learnt from);
without training documents counts are 0 and only spelling counts, at equal odds for each byte; repeated rows score alike; a very long text is a block
of its own; ties can't occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common
from lumigrid.llm.compact import from_planes, packed, planes, sorted_places, squeezed, stretched, unpacked
from lumigrid.llm.shingling import _mixed, hashed
from lumigrid.llm.spelling import GRAMS, Spelling, grams_of, letters_of

#: Words of the longest context; a context's least count, and its least gain over its suffix, in nats.
DEPTH, LEAST, MIN_DIVERGENCE = 2, 2, 4.0
#: How many occurrences the suffix's distribution counts for.
WEIGHT = 1.0
#: Gains are sent in these parts of a nat.
PARTS = 16
#: A block's bounds: tokens (and one text), and documents. Entries behind a range of hashes.
BLOCK, BLOCK_DOCS, RANGE = 1_000_000, 50_000, 2_000_000
SPARE = 12
#: The hash that stands for a text's end.
END = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64
_TURN = _U(0x9E3779B97F4A7C15)

BLOCKS = "block long, docs array<long>, helds array<boolean>, sizes array<long>, ids binary, words binary, letters binary, spellings binary, train long"
ASKED = "range int, block long, words binary, word_values binary, grams binary, gram_values binary"
ANSWERS = "round int, range int, block long, words binary, grams binary, distinct long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def blocks(base: DataFrame) -> DataFrame:
    """From (doc_id, text, held): BLOCKS. ids number the words in the order of their hashes; letters are how many
    bytes the words have, spellings these bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64())

        def done() -> pa.RecordBatch:
            words, first, ids = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            sizes = [len(h) for h in hashes]
            wide, raw = np.concatenate(letters), np.concatenate(spellings)
            begins, wide = (np.cumsum(wide) - wide)[first], wide[first]
            raw = raw[np.repeat(begins - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
            train = sum(n for n, held in zip(sizes, helds, strict=True) if not held)
            row = [block, docs, helds, sizes, planes(ids.astype(_U), max(1, len(words).bit_length())), squeezed(words, 0), packed(wide), zlib.compress(raw.tobytes(), 1), train]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=_names(BLOCKS))

        docs, helds, hashes, letters, spellings, size = [], [], [], [], [], 0
        for b in common.sliced(batches):
            texts = b.column(1).to_pylist()
            for doc_id, held, text, (h, n) in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts, hashed(texts), strict=True):
                docs.append(doc_id)
                helds.append(held)
                hashes.append(np.append(h, END))
                letters.append(np.append(n, 0))
                spellings.append(letters_of(text))
                size += len(h) + 1
                if size >= BLOCK or len(docs) >= BLOCK_DOCS:
                    yield done()
                    block += 1
                    docs, helds, hashes, letters, spellings, size = [], [], [], [], [], 0
        if docs:
            yield done()

    return base.mapInArrow(run, BLOCKS)


class Tokens:
    """A block's tokens: their words' numbers, and whether they are learnt from."""

    def __init__(self, row: dict):
        self.row, self.sizes = row, np.array(row["sizes"], dtype=np.int64)
        self.words = stretched(row["words"], 0)
        self.ids = from_planes(row["ids"], int(self.sizes.sum()), max(1, len(self.words).bit_length())).astype(np.int64)
        self.trains = np.repeat(~np.array(row["helds"], dtype=bool), self.sizes)

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes, one word after the other, and how many each has."""
        return np.frombuffer(zlib.decompress(self.row["spellings"]), dtype=np.uint8), unpacked(self.row["letters"])


class Block(Tokens):
    """Their places in their texts, too, and the n-grams that end at them."""

    def __init__(self, row: dict, bits: int):
        super().__init__(row)
        n = len(self.ids)
        starts = np.cumsum(self.sizes) - self.sizes
        self.starts, self.place = starts, np.arange(n) - np.repeat(starts, self.sizes)
        h = self.words[self.ids]
        grams, at, key = [], [], h
        for k in range(1, DEPTH + 1):  # of k + 1 words; mixed anew for each length
            key = np.concatenate([np.zeros(1, dtype=_U), _mixed(key[:-1] * _TURN + h[1:])])
            at.append(np.flatnonzero(self.place >= k))
            grams.append(key[at[-1]] >> _U(64 - bits))
        every = np.concatenate(grams)
        every, order = sorted_places(every, bits)
        new = np.ones(len(every), dtype=bool)
        new[1:] = every[1:] != every[:-1]
        self.grams, number = every[new], np.empty(len(every), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        #: For n-grams of k + 2 words: where they end, and their numbers.
        self.at, self.of = at, np.split(number, np.cumsum([len(x) for x in at])[:-1])

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """How often training texts hold each word and each n-gram."""
        grams = np.zeros(len(self.grams), dtype=np.int64)
        for at, of in zip(self.at, self.of, strict=True):
            grams += np.bincount(of[self.trains[at]], minlength=len(grams))
        return np.bincount(self.ids[self.trains], minlength=len(self.words)), grams

    def asked(self, word_counts: np.ndarray, gram_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words and n-grams that may be retained contexts, by number: frequent, and of at most DEPTH words, none an end."""
        context = np.zeros(len(self.grams), dtype=bool)
        for of in self.of[: DEPTH - 1]:
            context[of] = True
        return np.flatnonzero((word_counts >= LEAST) & (self.words != END)), np.flatnonzero(context & (gram_counts >= LEAST))

    def spread(self, word_values: np.ndarray, gram_values: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ... the values of the k-grams that end at each token; 0 where the text is shorter."""
        out = [word_values[self.ids]]
        for at, of in zip(self.at, self.of, strict=True):
            x = np.zeros(len(self.ids), dtype=gram_values.dtype)
            x[at] = gram_values[of]
            out.append(x)
        return out

    def contexts(self, values: list[np.ndarray], d: int) -> np.ndarray:
        """Of spread() values, those of the d words before each token; 0 where the text is shorter."""
        x = np.concatenate([np.zeros(1, dtype=values[d - 1].dtype), values[d - 1][:-1]])
        return np.where(self.place >= d, x, 0)


def root(counts: np.ndarray, spelled: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """Natural logarithms of single words' probabilities, from their counts and those of their spellings."""
    if not tokens:
        return spelled
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 0, np.log(np.maximum(counts, 0) + distinct * np.exp(spelled)), np.log(distinct) + spelled) - np.log(tokens + distinct)


def smoothed(both: np.ndarray, context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The logarithm of a word's probability after a context, from their counts and from that after the context's suffix."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, np.log(both + WEIGHT * np.exp(suffix)), np.log(WEIGHT) + suffix) - np.log(context + WEIGHT)


def gains(block: Block, counts: list[np.ndarray], spelled: np.ndarray, tokens: int, distinct: int) -> list[np.ndarray]:
    """For contexts of d = 1, 2, ... words before each token what they gain over their suffix, in PARTS of a nat; 0 in
    texts that are held out. Each occurrence is predicted from all others."""
    out, before = [], root(counts[0] - 1, spelled, tokens - 1, distinct)
    for d in range(1, DEPTH + 1):
        context = block.contexts(counts, d)
        use = block.trains & (block.place >= d) & (context > 0)
        now = np.where(use, smoothed(np.clip(counts[d] - 1, 0, np.maximum(context - 1, 0)), np.maximum(context - 1, 0), before), before)
        out.append(np.where(use, np.rint(PARTS * (now - before)), 0).astype(np.int64))
        before = now
    return out


def cut(keys: np.ndarray, values: np.ndarray, bits: int, ranges: int, kind: str) -> list[tuple[bytes, bytes]]:
    """Sorted keys of so many bits, and their values, by range."""
    step = bits - ranges
    ends = np.append(np.searchsorted(keys, np.arange(1 << ranges, dtype=_U) << _U(step)), len(keys))
    return [(squeezed(keys[a:z], r << step), packed(values[a:z], kind)) if z > a else (b"", b"") for r, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def messages(block: int, words: list[tuple[bytes, bytes]], grams: list[tuple[bytes, bytes]]) -> pa.Table:
    rows = [(r, block, *w, *g) for r, (w, g) in enumerate(zip(words, grams, strict=True)) if w[0] or g[0]]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=_names(ASKED))


def counted(told: DataFrame, bits: int, ranges: int) -> DataFrame:
    """ASKED: each block's words and n-grams, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                block = Block(row, bits)
                words, grams = block.seen()
                yield from messages(row["block"], cut(block.words, words, 64, ranges, "<u1"), cut(block.grams, grams, bits, ranges, "<u1")).to_batches()

    return told.mapInArrow(run, ASKED)


def answered(found: DataFrame, bits: int, ranges: int, round_: int) -> DataFrame:
    """ANSWERS to ASKED: the sums of all blocks' values in the order in which they were sent; in round 1 whether these reach
    MIN_DIVERGENCE."""

    def one(whole: pa.Table) -> pa.Table:
        out, distinct = [], 0
        kind = "<u2" if round_ else "<u1"
        for name, width in (("word", 64), ("gram", bits)):
            keys = [stretched(x, 0) for x in whole.column(f"{name}s").to_pylist()]  # from the range's first hash on
            values = np.concatenate([unpacked(x, kind) for x in whole.column(f"{name}_values").to_pylist()])
            every, order = sorted_places(np.concatenate(keys), width - ranges)
            new = np.ones(len(every), dtype=bool)
            new[1:] = every[1:] != every[:-1]
            heads = np.flatnonzero(new)
            sums = np.add.reduceat(values[order], heads) if len(heads) else values
            distinct = distinct or (int((sums > 0).sum()) if name == "word" else 0)
            all_ = np.empty(len(every), dtype=np.int64)
            all_[order] = np.repeat(sums, np.diff(np.append(heads, len(every))))
            ends = np.cumsum([0, *map(len, keys)])
            parts = [all_[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            out.append([np.packbits(x >= MIN_DIVERGENCE * PARTS).tobytes() if round_ else packed(x) for x in parts])
        n = whole.num_rows
        cols = [pa.array([round_] * n, pa.int32()), whole.column("range"), whole.column("block"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array([distinct, *[0] * (n - 1)], pa.int64())]
        return pa.Table.from_arrays(cols, names=_names(ANSWERS))

    return found.groupBy("range").applyInArrow(one, ANSWERS)


def sums_of(answers: list[dict]) -> list[np.ndarray]:
    rows = sorted((r for r in answers if r["round"] == 0), key=lambda r: r["range"])
    return [np.concatenate([np.empty(0, dtype=np.int64), *[unpacked(r[k]) for r in rows]]) for k in ("words", "grams")]


def lettered(told: DataFrame, sums: DataFrame) -> DataFrame:
    """GRAMS: the letters of the words that training texts hold once, summed over all blocks."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        block, counts = Tokens(left.to_pylist()[0]), sums_of(right.append_column("grams", pa.nulls(right.num_rows, pa.binary())).to_pylist())[0]
        once = np.zeros(len(counts), dtype=bool)
        once[block.ids[block.trains]] = True
        once &= (counts == 1) & (block.words != END)
        raw, sizes = block.bytes_of()
        keys, n = grams_of(raw[np.repeat(once, sizes)], sizes[once])
        return pa.Table.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n)], names=_names(GRAMS))

    few = told.select("block", "helds", "sizes", "ids", "words", "letters", "spellings")
    grams = few.groupBy("block").cogroup(sums.select("round", "range", "block", "words").groupBy("block")).applyInArrow(one, GRAMS)
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def gained(told: DataFrame, sums: DataFrame, bits: int, ranges: int, tokens: int, distinct: int, spelling: Spelling) -> DataFrame:
    """ASKED: each block's contexts, with what their occurrences gain."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block, (words, grams) = Block(row, bits), sums_of(right.to_pylist())
        counts = block.spread(words, grams)
        got = gains(block, counts, spelling.logs(*block.bytes_of())[block.ids], tokens, distinct)
        before = block.ids[np.maximum(np.arange(len(block.ids)) - 1, 0)]
        of_words = np.bincount(before, weights=got[0], minlength=len(words)).astype(np.int64)
        of_grams = np.zeros(len(grams), dtype=np.int64)
        for at, of, x in zip(block.at, block.of, got[1:], strict=False):
            inside = at[at + 1 < len(x)]
            of_grams += np.bincount(of[: len(inside)], weights=x[inside + 1], minlength=len(grams)).astype(np.int64)
        w, g = block.asked(words, grams)
        return messages(row["block"], cut(block.words[w], of_words[w], 64, ranges, "<u2"), cut(block.grams[g], of_grams[g], bits, ranges, "<u2"))

    return told.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(one, ASKED)


def scored(told: DataFrame, answers: DataFrame, bits: int, ranges: int, tokens: int, distinct: int, spelling: Spelling) -> DataFrame:
    """SCORES of the blocks' documents."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        row, said = left.to_pylist()[0], right.to_pylist()
        block, (words, grams) = Block(row, bits), sums_of(said)
        flags = {r["range"]: r for r in said if r["round"] == 1}
        retained = []
        for name, keys, width, chosen, n in zip(("words", "grams"), (block.words, block.grams), (64, bits), block.asked(words, grams), (len(words), len(grams)), strict=True):
            whole = np.zeros(n, dtype=bool)
            if len(chosen):
                of = (keys[chosen] >> _U(width - ranges)).astype(np.int64)
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                whole[chosen] = np.concatenate([np.unpackbits(np.frombuffer(flags[int(of[a])][name], dtype=np.uint8), count=z - a) for a, z in zip(heads, np.append(heads[1:], len(of)), strict=True)]).astype(bool)
            retained.append(whole)
        counts, kept = block.spread(words, grams), block.spread(*retained)
        log = root(counts[0], spelling.logs(*block.bytes_of())[block.ids], tokens, distinct)
        for d in range(1, DEPTH + 1):
            context = block.contexts(counts, d)
            log = np.where(block.contexts(kept, d) & (context > 0), smoothed(np.minimum(counts[d], context), context, log), log)
        total = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  each text has its end at least
        base = np.log10((counts[0] + 1) / (tokens + distinct + 1))
        n = len(block.sizes)
        cols = [pa.array(row["docs"], pa.int64()), pa.array(row["helds"], pa.bool_()), pa.array(block.sizes), pa.array(total((counts[0] > 0).astype(np.int64))), pa.array(np.full(n, tokens)), pa.array(total(base)), pa.array(total(log) / np.log(10.0))]
        return pa.Table.from_arrays(cols, names=_names(SCORES))

    return told.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, SCORES)


def score(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with common.Scratch(docs.sparkSession) as scratch:
        held = F.coalesce(common.crc_mod("doc_id", 7) == 2, F.lit(False))
        told = common.bucketed(blocks(common.corpus(docs).select("doc_id", "text", held.alias("held"))), "blocks", "block")
        sums = told.agg(F.sum("train"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, x: acc + x))).first()
        tokens, every = sums[0] or 0, sums[1] or 0
        bits = min(64, max(32, (every * DEPTH).bit_length() + SPARE))
        ranges = min(20, max(6, (every * (DEPTH + 1) // RANGE).bit_length()))
        sums = answered(counted(told, bits, ranges), bits, ranges, 0)
        # dealt by block once; what follows meets the blocks where they are
        counts = common.bucketed(sums.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block"), "gram-counts", "block")
        distinct = counts.agg(F.sum("distinct")).first()[0] or 0
        spelling = Spelling.learnt(lettered(told, counts))
        flags = common.written(answered(gained(told, counts, bits, ranges, tokens, distinct, spelling), bits, ranges, 1), "contexts")
        return scratch.keep(common.written(scored(told, counts.unionByName(flags), bits, ranges, tokens, distinct, spelling), "scores"))
