"""Every row against every row, block by block: exact ranks and histograms without a row for each pair.

Rows are packed into blocks of NumPy arrays. Every task reads each block, holds a few blocks of queries, meets the others
one after the other, and keeps what a query needs: its best candidates or counts of rounded scores. An exact
product has as many block pairs; a task holds its blocks, one more and its sums, whatever the number of rows. Nearest
neighbours need not meet all: operators.pivots leaves out pairs of blocks that can't hold any.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.sources import shared

#: Rows of a block at most, and the blocks that smaller inputs are cut into so that several tasks share them.
SIZE, SPREAD, FEWEST = 2048, 8, 128
#: Blocks of queries that a task holds at most, and how many tasks there are before any holds more than one.
HELD, TASKS = 8, 64
#: Pairs of a block that are scored in single precision at once, and the share of them beyond which all are scored exactly.
STRIP, DENSE = 1 << 16, 0.1
#: Columns of a block that are scored exactly to begin with; pairs that are compared with a lead at once; the share of pairs
#: that a lead may leave; rows that leads are tried on; groups of equal categories that are met one by one, at most; and pairs
#: of two blocks beyond which those without a lead are taken by parts.
SEED, LED, LOOSE, TRIED, GROUPS, PART = 256, 1 << 18, 0.05, 16, 16, 1 << 22
TINY = 1e-7
MAX_COLOR = math.sqrt(255 * 255 * 3)

Arrays = dict[str, np.ndarray]


def count_of(rows: int, size: int = SIZE) -> int:
    return max(1, -(-rows // size), min(SPREAD, rows // FEWEST))


def arrays_of(name: str, values: pd.Series) -> Arrays:
    """A column of a block as arrays: vectors as a matrix, with zeros for null rows, which <name>?null marks; lists of longs
    (name begins with "*") one after the other, with their lengths."""
    if name.startswith("*"):
        lists = [np.asarray(v if v is not None else [], dtype=np.int64) for v in values]
        return {name: np.concatenate([np.empty(0, dtype=np.int64), *lists]), f"{name}?size": np.array([len(v) for v in lists])}
    if values.dtype == object and values.notna().any() and not isinstance(values[values.notna()].iloc[0], str):
        known = values.notna().to_numpy()
        matrix = np.zeros((len(values), len(values[known].iloc[0])))
        matrix[known] = np.array(values[known].tolist(), dtype=np.float64)
        return {name: matrix, f"{name}?null": ~known}
    if values.dtype == object and not values.notna().any():
        return {name: np.zeros((len(values), 0)), f"{name}?null": np.ones(len(values), dtype=bool)}
    return {name: values.to_numpy()}


def saved(arrays: Arrays) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def loaded(payload: bytes) -> Arrays:
    with np.load(io.BytesIO(payload)) as stored:
        return dict(stored)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, ...) with the number of their block, of n."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def packed(df: DataFrame, columns: dict[str, Column], size: int = SIZE) -> tuple[DataFrame, int]:
    """(block, payload) of df (id and columns), and the number of blocks; rows of a block are sorted by id."""
    rows = df.select(F.col("id").cast("long").alias("id"), *[c.alias(n) for n, c in columns.items()])
    n, names = count_of(rows.count(), size), list(columns)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        out: Arrays = {"id": pdf["id"].to_numpy()}
        for name in names:
            out |= arrays_of(name, pdf[name])
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "payload": [saved(out)]})

    return dealt(rows, n).groupBy("block").applyInPandas(pack, "block int, payload binary"), n


def met(blocks: DataFrame, n: int, begin: Callable[[Arrays], object], meet: Callable[[object, Arrays, Arrays], object], finish: Callable[[object, Arrays], dict | Iterator[dict]], schema: str, most: int | None = None, listed: DataFrame | None = None) -> DataFrame:
    """finish(sums, queries) of each block of queries, after meet(sums, queries, candidates) with every block, its own first.

    A task holds up to HELD blocks of queries (or `most`). Blocks are written once to the shared folder, where each task reads
    all of them, one after the other: no block is shuffled, and what is written grows as the rows do. listed: (block) of the
    blocks where a table has them already."""
    groups = max(1, min(n, max(TASKS, -(-n // (most or HELD)))))
    names = [x.split()[0] for x in schema.split(", ")]
    path, known = shared.by_number(blocks, "block", "met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda some: (loaded(x) for b in some for x in shared.read_number(path, b, "payload"))
        for at in (x for batch in batches for x in batch.column(0).to_pylist()):
            held = list(read([b for b in known if b % groups == at]))
            sums = [meet(begin(q), q, q) for q in held]
            for i, q in enumerate(held):
                for j, c in enumerate(held):
                    if i != j:
                        sums[i] = meet(sums[i], q, c)
            if held:
                for c in read([b for b in known if b % groups != at]):
                    for i, q in enumerate(held):
                        sums[i] = meet(sums[i], q, c)
            for i, q in enumerate(held):
                got = finish(sums[i], q)
                for part in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_pydict({x: part[x] for x in names})
                sums[i] = None

    if listed is None:
        return blocks.sparkSession.range(0, groups, 1, groups).mapInArrow(run, schema)
    return listed.select((F.col("block") % groups).cast("long").alias("at")).distinct().repartition(groups, "at").mapInArrow(run, schema)


def whole(sims: np.ndarray, places: int, kind: type = np.int64) -> np.ndarray:
    """Rounded scores as whole numbers."""
    return np.rint(sims * 10.0**places).astype(kind)


class Best:
    """Each query's k best candidates: by rounded score, then by the lower id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id, self.y = k, np.zeros((queries, 0), dtype=np.int64), np.zeros((queries, 0), dtype=np.int64), np.zeros((queries, 0), dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, y: np.ndarray | None = None, skip: np.ndarray | None = None) -> Best:
        """skip marks pairs that don't count. ids are sorted, so a column's number stands for its id."""
        n = score.shape[1]
        key = -score * n + np.arange(n)
        if skip is not None:
            key = np.where(skip, np.iinfo(np.int64).max, key)
        k = min(self.k, n)
        chosen = np.argpartition(key, k - 1, axis=1)[:, :k]
        left = np.take_along_axis(key, chosen, 1) == np.iinfo(np.int64).max
        new = np.where(left, np.iinfo(np.int64).min, np.take_along_axis(score, chosen, 1))
        self.score = np.concatenate([self.score, new], 1)
        self.id = np.concatenate([self.id, ids[chosen]], 1)
        self.y = np.concatenate([self.y, np.take_along_axis(y, chosen, 1) if y is not None else np.zeros(chosen.shape, dtype=np.int64)], 1)
        last = self.score == np.iinfo(np.int64).min  # its negative is itself
        order = np.lexsort((self.id, np.where(last, np.iinfo(np.int64).max, -self.score)), axis=1)[:, : self.k]
        self.score, self.id, self.y = (np.take_along_axis(x, order, 1) for x in (self.score, self.id, self.y))
        return self

    def least(self, places: int) -> np.ndarray:
        """What a score must reach to be among the best of each query."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), -np.inf)
        last = self.score[:, -1]
        return np.where(last == np.iinfo(np.int64).min, -np.inf, (last - 0.5) / 10.0**places)

    def merge(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """add() of single candidates of the queries i, of which each has k columns already."""
        some, at = np.unique(i, return_inverse=True)
        k = self.score.shape[1]
        row = np.concatenate([np.repeat(np.arange(len(some)), k), at])
        held = [np.concatenate([mine[some].ravel(), new]) for mine, new in ((self.score, score), (self.id, ids), (self.y, y))]
        last = held[0] == np.iinfo(np.int64).min
        order = np.lexsort((held[1], np.where(last, np.iinfo(np.int64).max, -held[0]), row))
        heads = np.searchsorted(row[order], np.arange(len(some)))
        chosen = order[heads[:, None] + np.arange(k)[None, :]]
        self.score[some], self.id[some], self.y[some] = (x[chosen] for x in held)

    def rows(self, ids: np.ndarray, places: int) -> dict:
        keep = self.score != np.iinfo(np.int64).min
        rank = np.broadcast_to(np.arange(1, self.score.shape[1] + 1), self.score.shape)
        return {"q": np.broadcast_to(ids[:, None], self.score.shape)[keep], "c": self.id[keep], "rank": rank[keep].astype(np.int64), "sim": self.score[keep] / 10.0**places + 0.0, "y": self.y[keep]}


def product(a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
    if a.shape[1] != b.shape[1]:
        return np.zeros(len(a) if paired else (len(a), len(b)), dtype=a.dtype)
    return np.einsum("ij,ij->i", a, b) if paired else a @ b.T


def unit(x: np.ndarray, epsilon: float) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + epsilon)


# the offline similarities of operators.similarity, for two blocks


def kernel(distance: np.ndarray) -> np.ndarray:
    near = np.clip(distance, 0.0, 1.0)
    near *= np.pi
    np.cos(near, out=near)
    near += 1.0
    near /= 2.0
    return near


#: kernel(1 - c) for c from 0 to 1 as a polynomial of 2 * c * c - 1, which is off by about 1e-15.
NEARNESS = chebyshev.cheb2poly(chebyshev.chebinterpolate(lambda t: (1.0 - np.cos(np.pi * np.sqrt((t + 1.0) / 2.0))) / 2.0, 10))


def nearness(c: np.ndarray) -> np.ndarray:
    """kernel(1 - c)."""
    t = np.clip(c, 0.0, 1.0)
    t *= t
    t *= 2.0
    t -= 1.0
    out = t * NEARNESS[-1]
    for a in NEARNESS[-2:0:-1]:
        out += a
        out *= t
    out += NEARNESS[0]
    return out


def columns_of(features: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """What packed() takes for these features (column, metric)."""
    out = {}
    for name, (column, metric) in features.items():
        c = F.col(column)
        if metric in ("scalar", "sharpness"):
            out[name] = F.coalesce(c.cast("double"), F.lit(0.0))
        elif metric == "category":
            out[name] = F.xxhash64(F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("General"))))
        elif metric == "entity":
            out[f"*{name}"] = F.transform(F.array_distinct(F.transform(c, F.lower)), lambda x: F.xxhash64(x))
        else:
            out[name] = c.cast("array<double>")
    return out


def similarity(metric: str, name: str, a: Arrays, b: Arrays, paired: bool = False, kind: type = np.float64) -> np.ndarray:
    """Of all rows of a with all of b; paired (of the metrics SCREENED): of a's rows with b's at the same place."""
    if metric == "entity":
        values, at = np.unique(np.concatenate([a[f"*{name}"], b[f"*{name}"]]), return_inverse=True)
        sizes = [x[f"*{name}?size"] for x in (a, b)]
        held = []
        for size, own in zip(sizes, np.split(at, [len(a[f"*{name}"])]), strict=True):
            m = np.zeros((len(size), len(values)), dtype=np.float32)
            m[np.repeat(np.arange(len(size)), size), own] = 1
            held.append(m)
        most = np.maximum(sizes[0][:, None], sizes[1][None, :])
        both = (sizes[0][:, None] > 0) & (sizes[1][None, :] > 0)
        return np.where(both, kernel(1.0 - (held[0] @ held[1].T).astype(float) / np.maximum(most, 1)), 0.0)
    x, y = a[name], b[name]
    if metric == "cosine":
        return kernel(1.0 - product(unit(x, TINY).astype(kind), unit(y, TINY).astype(kind), paired))
    if metric == "plain":  # the cosine itself
        return product(unit(x, 0.0).astype(kind), unit(y, 0.0).astype(kind), paired)
    if metric == "product":  # of vectors no longer than 1
        return product(x.astype(kind), y.astype(kind), paired)
    if metric in SCREENED:
        x, y = (x, y) if paired else (x[:, None], y[None, :])
        if metric == "scalar":
            return kernel(np.abs(x - y).astype(kind))
        if metric == "sharpness":
            return kernel((np.abs(x - y) / (np.abs(x + y) + TINY)).astype(kind))
        return (x == y).astype(kind)
    dim = max(x.shape[1], y.shape[1])
    x, y = (v if v.shape[1] else np.zeros((len(v), dim)) for v in (x, y))
    distance = np.sqrt(np.maximum(np.array([((y - row) ** 2).sum(1) for row in x]).reshape(len(x), len(y)), 0.0))
    known = ~(a[f"{name}?null"][:, None] & b[f"{name}?null"][None, :])
    return kernel(np.where(known, distance / (MAX_COLOR if metric == "l2_color" else 255.0 * math.sqrt(max(dim, 1))), 0.0))


def weighted(metrics: dict[str, str], weights: dict[str, float], score: Callable[[Arrays, Arrays], np.ndarray], places: int) -> Callable[[Arrays, Arrays], np.ndarray]:
    """whole() of score, the sum of weighted similarities, a few rows at a time; what the kernel makes of scalars at most 1 apart,
    and few categories, are sums of products: cos(x - y) is cos(x) cos(y) + sin(x) sin(y)."""
    if not all(m in SCREENED for m in metrics.values()):
        return lambda q, c: whole(score(q, c), places, np.int32)
    kinds = [n for n, m in metrics.items() if m == "category"]

    def run(q: Arrays, c: Arrays) -> np.ndarray:
        left, right = [np.zeros((len(q["id"]), 1))], [np.ones((len(c["id"]), 1))]
        others = {}
        for n, m in metrics.items():
            w, x, y = weights[n], q[n], c[n]
            if m == "scalar" and len(x) and len(y) and max(x.max() - y.min(), y.max() - x.min()) <= 1.0:
                left += [np.cos(np.pi * x)[:, None] * (w / 2), np.sin(np.pi * x)[:, None] * (w / 2)]
                right += [np.cos(np.pi * y)[:, None], np.sin(np.pi * y)[:, None]]
                left[0] += w / 2
            elif n in kinds and len(values := np.intersect1d(x, y)) <= GROUPS:
                left.append((x[:, None] == values) * w)
                right.append((y[:, None] == values) * 1.0)
            else:
                others[n] = m
        mine, theirs = np.concatenate(left, 1), np.ascontiguousarray(np.concatenate(right, 1).T)
        # vectors become unit vectors once, not for each few rows
        units = [{n: unit(z[n], 0.0 if m == "plain" else TINY) if m in ("cosine", "plain") else z[n] for n, m in others.items()} for z in (q, c)]
        out, step = np.empty((len(mine), theirs.shape[1]), dtype=np.int32), max(1, STRIP // 4 // max(1, theirs.shape[1]))
        for a in range(0, len(mine), step):
            some = mine[a : a + step] @ theirs
            for n, m in others.items():
                if m in VECTORS:
                    s = product(units[0][n][a : a + step], units[1][n])
                    s = nearness(s) if m == "cosine" else s
                else:
                    s = similarity(m, n, {n: q[n][a : a + step]}, {n: c[n]})
                s *= weights[n]
                some += s
            some *= 10.0**places
            out[a : a + step] = np.rint(some, out=some)
        return out

    return run


#: Metrics that can be worked out in single precision first, and for single pairs.
SCREENED = ("scalar", "sharpness", "category", "cosine", "plain", "product")
VECTORS = ("cosine", "plain", "product")


def taken(arrays: Arrays, rows: np.ndarray | slice) -> Arrays:
    return {n: x[rows] for n, x in arrays.items() if not n.startswith("*")}


def same_ids(q: Arrays, c: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of one id; ids of a block are sorted."""
    low, high = (np.searchsorted(c["id"], q["id"], side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(low)), high - low)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)


def few(marked: np.ndarray) -> np.ndarray:
    """flatnonzero() of a matrix with few marks, eight of which are looked at together."""
    flat = np.ascontiguousarray(marked).ravel()
    end = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:end].view(np.uint64))[:, None] * 8 + np.arange(8)[None, :]).ravel()
    return np.concatenate([near[flat[near]], end + np.flatnonzero(flat[end:])])


class Scores:
    """Weighted sums of similarities (metric by name) under several vectors of weights (weight by name), of which those that
    aren't positive count for nothing."""

    def __init__(self, metrics: dict[str, str], vectors: list[dict[str, float]], leading: bool = True):
        self.metrics, self.leading = metrics, leading and len(metrics) > 1
        self.vectors = [{n: w for n, w in v.items() if w > 0 and n in metrics} for v in vectors]
        self.weights = np.array([[v.get(n, 0.0) for n in metrics] for v in self.vectors]).reshape(len(vectors), len(metrics))

    def _sum(self, sims: dict[str, np.ndarray], t: int, shape: tuple) -> np.ndarray:
        parts = [sims[n] * w for n, w in self.vectors[t].items()]
        return sum(parts[1:], parts[0]) if parts else np.zeros(shape)

    def all(self, q: Arrays, c: Arrays) -> list[np.ndarray]:
        sims = {n: similarity(m, n, q, c) for n, m in self.metrics.items()}
        return [self._sum(sims, t, (len(q["id"]), len(c["id"]))) for t in range(len(self.vectors))]

    def ready(self, x: Arrays) -> dict:
        """What a block's pairs are screened by, worked out once and kept with it: unit vectors, and the rows of each group of
        equal categories, with their vectors in single precision."""
        if "*ready" not in x:
            units = {n: x[n] if m == "product" else unit(x[n], 0.0 if m == "plain" else TINY) for n, m in self.metrics.items() if m in VECTORS}
            said = [x[n] for n, m in self.metrics.items() if m == "category"]
            keys, of = np.unique(np.stack(said, 1), axis=0, return_inverse=True) if said else (np.empty((1, 0)), np.zeros(len(x["id"]), dtype=np.int64))
            if len(keys) > GROUPS:
                keys, of = [None], np.zeros(len(x["id"]), dtype=np.int64)
            groups = [(key, rows, {n: v[rows].astype(np.float32) for n, v in units.items()}) for key, rows in ((key, np.flatnonzero(of.ravel() == g)) for g, key in enumerate(keys))]
            able = {n: v.any(1) for n, v in units.items() if self.metrics[n] == "cosine"}
            x["*ready"] = {"units": units, "groups": groups, "able": able, "met": 0, "leads": []}
        return x["*ready"]

    def of_pairs(self, q: Arrays, i: np.ndarray, c: Arrays, j: np.ndarray) -> dict[str, np.ndarray]:
        """The similarities of the pairs (i, j)."""
        out, a, b = {}, self.ready(q)["units"], self.ready(c)["units"]
        for n, m in self.metrics.items():
            if m in VECTORS:
                s = product(a[n][i], b[n][j], True)
                out[n] = kernel(1.0 - s) if m == "cosine" else s
            else:
                out[n] = similarity(m, n, {n: q[n][i]}, {n: c[n][j]}, True)
        return out

    def offer(self, bests: list[Best], q: Arrays, c: Arrays, y: Callable[[np.ndarray, np.ndarray], np.ndarray], places: int, selves: bool = False) -> None:
        """Adds c's rows to each query's best under each vector, those of the query's id only with `selves`. Where queries have k candidates, pairs are screened
        first, and scored exactly only if they may be among the best; y(i, j) says whether pairs are relevant."""
        columns, quick = len(c["id"]), bool(self.metrics) and all(m in SCREENED for m in self.metrics.values())
        if quick and columns > 2 * SEED and any(b.score.shape[1] < b.k for b in bests):
            a = 0
            while a < columns:  # ever more, as the best so far leave ever fewer
                self.offer(bests, q, taken(c, slice(a, max(SEED, 2 * a))), lambda i, j, a=a: y(i, j + a), places, selves)
                a = max(SEED, 2 * a)
            return
        least = np.array([b.least(places) for b in bests])
        found = self._screened(least, q, c) if quick and np.isfinite(least).mean() > 1 - DENSE else None
        every = [t for t in range(len(bests)) if found is None or found[t] is None]
        if every and quick and columns * len(q["id"]) > PART and columns > SEED:
            plain, step = Scores(self.metrics, [self.vectors[t] for t in every], leading=False), max(SEED, PART // len(q["id"]))
            for a in range(0, columns, step):
                plain.offer([bests[t] for t in every], q, taken(c, slice(a, a + step)), lambda i, j, a=a: y(i, j + a), places, selves)
        elif every:
            skip = np.zeros((len(q["id"]), columns), dtype=bool)
            if not selves:
                skip[same_ids(q, c)] = True
            i, j = np.divmod(np.arange(skip.size), columns)
            relevant = y(i, j).reshape(skip.shape)
            sims = {n: similarity(m, n, q, c) for n, m in self.metrics.items() if any(n in self.vectors[t] for t in every)}
            for t in every:
                bests[t].add(whole(self._sum(sims, t, skip.shape), places), c["id"], relevant, skip)
        together: dict[int, tuple[np.ndarray, list[int]]] = {}  # vectors that share their pairs share similarities
        for t, at in enumerate(found or []):
            if at is not None and len(at):
                together.setdefault(id(at), (at, []))[1].append(t)
        for at, trials in together.values():
            floor = np.ascontiguousarray(least[trials].T) - 1e-9
            for a in range(0, len(at), STRIP):
                i, j = np.divmod(at[a : a + STRIP], columns)
                if not selves:
                    other = q["id"][i] != c["id"][j]
                    i, j = i[other], j[other]
                sims = self.of_pairs(q, i, c, j)
                pair, of = np.divmod(few(np.stack(list(sims.values()), 1) @ self.weights[trials].T >= floor[i]), len(trials))
                for n, t in enumerate(trials):
                    some = pair[of == n]
                    x, z, best = i[some], j[some], bests[t]
                    score, last = whole(self._sum({n: v[some] for n, v in sims.items()}, t, x.shape), places), best.score[x, -1]
                    keep = (score > last) | ((score == last) & (c["id"][z] < best.id[x, -1]))
                    if keep.any():
                        best.merge(x[keep], score[keep], c["id"][z[keep]], y(x[keep], z[keep]))

    def _leads(self, least: np.ndarray, q: Arrays, c: Arrays) -> list[str | None]:
        """For each vector the metric that alone leaves the fewest pairs which may reach `least`, tried on a few rows; None if
        each leaves many. They are chosen again as q meets twice as many blocks, and while there are none."""
        held = self.ready(q)
        held["met"] += 1
        if held["met"] & (held["met"] - 1) and None not in held["leads"]:
            return held["leads"]
        rows = np.unique(np.linspace(0, len(q["id"]) - 1, TRIED).astype(int))
        some = taken(q, rows)
        sims = {n: similarity(m, n, some, c) for n, m in self.metrics.items()}
        held["leads"] = []
        for t, v in enumerate(self.vectors):
            shares = {}
            for lead in (n for n in v if self.metrics[n] != "category"):
                most = sum(w * (sims[n] if self.metrics[n] == "category" else 1.0) for n, w in v.items() if n != lead)
                shares[lead] = (v[lead] * sims[lead] + most >= least[t, rows][:, None] - 1e-9).mean()
            lead = min(shares, key=shares.get, default=None)
            held["leads"].append(lead if lead is not None and shares[lead] <= LOOSE else None)
        return held["leads"]

    def _need(self, lead: str, trials: list[int], least: np.ndarray, same: dict[str, bool], able: Arrays) -> np.ndarray:
        """What each row's similarity by `lead` must be at least under any of these vectors, if the others add what they can at
        most (zero vectors nothing), and categories what they do."""
        need = np.full(least.shape[1], np.inf)
        for t in trials:
            v = self.vectors[t]
            most = sum(w * same.get(n, able.get(n, 1.0)) for n, w in v.items() if n != lead)
            np.minimum(need, (least[t] - 1e-9 - most) / v[lead] if lead in v else -np.inf, out=need)
        return need

    def _led(self, lead: str, trials: list[int], least: np.ndarray, q: Arrays, c: Arrays) -> np.ndarray | None:
        """Pairs (row * columns + column) that may reach `least` under any of these vectors, by `lead` alone, or by another metric
        for rows that `lead` asks nothing of; None if they are many."""
        needs, found, total = {}, [], 0
        kinds = [n for n, m in self.metrics.items() if m == "category"]
        order = [lead, *(n for n in self.metrics if n != lead and n not in kinds)]
        for key, rows, mine in self.ready(q)["groups"]:
            for other, at, theirs in self.ready(c)["groups"]:
                same = tuple(key == other) if key is not None and other is not None else (True,) * len(kinds)
                left = np.arange(len(rows))
                for n in order:
                    if (same, n) not in needs:
                        needs[same, n] = self._need(n, trials, least, dict(zip(kinds, same, strict=True)), self.ready(q)["able"])
                    need = needs[same, n][rows[left]]
                    now = (need <= 1.0) & ((need > 0) | (n == order[-1]))
                    for r, k in self._reaching(n, q, rows, mine, left[now], need[now], c, at, theirs):
                        total += len(r)
                        found.append(rows[r] * len(c["id"]) + at[k])
                    left = left[(need <= 1.0) & ~now]
                    if not len(left):
                        break
                if total > DENSE * len(q["id"]) * len(c["id"]):
                    return None
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def _reaching(self, name: str, q: Arrays, rows: np.ndarray, mine: Arrays, left: np.ndarray, need: np.ndarray, c: Arrays, at: np.ndarray, theirs: Arrays) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in rows, place in at) of the pairs whose similarity by one metric may be `need`; of the places `left`."""
        metric = self.metrics[name]
        straight = metric in ("plain", "product")
        # the similarity, or the distance that the kernel allows
        bound = need if straight else np.where(need > 0, np.arccos(np.clip(2.0 * need - 1.0, -1.0, 1.0)) / np.pi, np.inf)
        step = max(1, LED // max(1, len(at)))
        for a in range(0, len(left), step):
            some, limit = left[a : a + step], bound[a : a + step, None]
            if metric in VECTORS:
                # how far a product in single precision may be off
                floor = (limit if straight else 1.0 - limit) - (q[name].shape[1] + 32) * 2.0 * np.finfo(np.float32).eps
                over = product(mine[name][some], theirs[name]) >= floor.astype(np.float32)
            else:
                x, y = q[name][rows[some], None], c[name][at][None, :]
                over = np.abs(x - y) <= limit * (np.abs(x + y) + TINY if metric == "sharpness" else 1.0)
            r, k = np.divmod(few(over), len(at))
            yield some[r], k

    def _screened(self, least: np.ndarray, q: Arrays, c: Arrays) -> list[np.ndarray | None] | None:
        """For each vector the pairs (row * columns + column) that may reach `least`, and None where they are many: by a metric
        that leads, or else by all in single precision."""
        leads, out = self._leads(least, q, c) if self.leading else [None] * len(self.vectors), [None] * len(self.vectors)
        for lead in dict.fromkeys(x for x in leads if x is not None):
            trials = [t for t, x in enumerate(leads) if x == lead]
            at = self._led(lead, trials, least, q, c)
            for t in trials:
                out[t] = at
        left = [t for t, x in enumerate(out) if x is None]
        if left and len(q["id"]) * len(c["id"]) <= max(PART, SEED * len(q["id"])):
            used = {n: m for n, m in self.metrics.items() if any(n in self.vectors[t] for t in left)}
            got = Scores(used, [self.vectors[t] for t in left])._in_single(least[left], q, c) if used else None
            for t, at in zip(left, got or [None] * len(left), strict=True):
                out[t] = at
        return out if any(x is not None for x in out) else None

    def _in_single(self, least: np.ndarray, q: Arrays, c: Arrays) -> list[np.ndarray] | None:
        """For each vector the pairs (row * columns + column) that may reach `least`, in single precision; None if they are many."""
        rows, columns, vectors = len(q["id"]), len(c["id"]), len(self.vectors)
        width = max((q[n].shape[1] for n in self.metrics if q[n].ndim > 1), default=0)
        # how far a sum of products in single precision may be off, through the kernel, whose slope is at most pi / 2
        off = self.weights.sum(1) * (width + 32) * 2.0 * np.finfo(np.float32).eps
        floor = (least - off[:, None] - 1e-9).astype(np.float32)
        weights, found, total = self.weights.astype(np.float32), [[] for _ in range(vectors)], 0
        units = lambda x: {n: v if self.metrics[n] == "product" else unit(v, 0.0 if self.metrics[n] == "plain" else TINY) for n, v in ((n, x[n]) for n in self.metrics) if v.ndim > 1}
        q, c = q | units(q), c | {n: v.astype(np.float32) for n, v in units(c).items()}
        step = max(1, STRIP // max(1, columns))
        for a in range(0, rows, step):
            some = taken(q, slice(a, a + step))
            sims = []
            for n, m in self.metrics.items():
                if m in ("cosine", "plain", "product"):
                    s = product(some[n].astype(np.float32), c[n])
                    sims.append(kernel(1.0 - s) if m == "cosine" else s)
                else:
                    sims.append(similarity(m, n, some, c, kind=np.float32))
            if vectors == 1:
                for s, w in zip(sims, weights[0], strict=True):
                    s *= w
                for s in sims[1:]:
                    sims[0] += s
            near = sims[0][None] if vectors == 1 else (weights @ np.stack(sims).reshape(len(sims), -1)).reshape(vectors, *sims[0].shape)
            over = near >= floor[:, a : a + step, None]
            for t in range(vectors):
                got = np.flatnonzero(over[t])
                total += len(got)
                found[t].append(got + a * columns)
            if total > DENSE * vectors * rows * columns:
                return None
        return [np.concatenate(f) for f in found]
