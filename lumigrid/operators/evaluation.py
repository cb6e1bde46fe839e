"""Retrieval evaluation with windows: average precision, mean average precision, precision at k, curves and reports.

Scored pairs are rows (q, c, sim, y): candidate c of query q with its score and whether it is relevant. Ranks break
ties by the candidate, so results are repeatable; average precision over all ranks groups ties as one threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumigrid.operators import products
from lumigrid.operators.features import FeatureStore, label_columns, pieces
from lumigrid.sources import shared

#: Scores of pairs are compared at this many places.
PLACES = 4
#: Queries of a block whose scores are counted, at most; scores that a block may hold, of four bytes each, since each query has
#: one for each row; and how many of these are sorted at once.
COUNTED, ENTRIES, SORTED = 512, 100_000_000, 4_000_000
#: Counts that a query has at most where scores have a bound (`score.most`), and candidates that are held before they are counted.
BINS, WAITING = 1 << 16, 1 << 16
#: Queries of a block that is sampled, and the first bits of hashes that are counted.
SAMPLED, BITS = 64, 12
FIRST = 1 << BITS


def ranked(pairs: DataFrame) -> DataFrame:
    """pairs with rk (rank in the query), pos (relevant candidates of the query) and hits (relevant up to the rank)."""
    in_order = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return pairs.withColumn("rk", F.row_number().over(in_order)).withColumn("pos", F.sum("y").over(Window.partitionBy("q"))).withColumn("hits", F.sum("y").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))


def ap_at_k(pairs: DataFrame, k: int) -> DataFrame:
    """(q, ap) of the queries with relevant candidates: precision at each hit among the first k, over min(relevant, k)."""
    return ap_of_ranks(ranked(pairs), k)


def ap_of_ranks(ranks: DataFrame, k: int) -> DataFrame:
    """ap_at_k() of rows that have their ranks already, the first k of each query at least."""
    hit = F.when((F.col("y") == 1) & (F.col("rk") <= k), F.col("hits").cast("double") / F.col("rk")).otherwise(0.0)
    return ranks.where("pos > 0").groupBy("q").agg((F.sum(hit) / F.least(F.max("pos"), F.lit(k))).alias("ap"))


def ap_full(pairs: DataFrame) -> DataFrame:
    """(q, ap) over all ranks: the sum of precision times the gain of recall at each distinct score."""
    steps = pairs.groupBy("q", "sim").agg(F.sum("y").alias("yy"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("q").orderBy(F.desc("sim")).rowsBetween(Window.unboundedPreceding, 0)
    s = steps.withColumn("tp", F.sum("yy").over(down)).withColumn("nn", F.sum("n").over(down)).withColumn("pos", F.sum("yy").over(Window.partitionBy("q"))).where("pos > 0")
    return s.groupBy("q").agg(F.sum(F.col("yy").cast("double") / F.col("pos") * F.col("tp").cast("double") / F.col("nn")).alias("ap"))


def mean_ap(aps: DataFrame, name: str = "map") -> DataFrame:
    return aps.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias(name), F.count(F.lit(1)).alias("n"))


def precision_at(pairs: DataFrame, most: int = 20) -> DataFrame:
    """(k, precision) for k = 1 to most: the mean over queries with relevant candidates of the share of relevant ones
    among the first k (or as many as there are)."""
    return precision_of_ranks(ranked(pairs), most)


def precision_of_ranks(ranks: DataFrame, most: int = 20) -> DataFrame:
    top = ranks.where(f"pos > 0 and rk <= {most}").select("q", "rk", "y")
    ks = ranks.sparkSession.range(1, most + 1).select(F.col("id").alias("k"))
    per = top.join(F.broadcast(ks), F.col("rk") <= F.col("k")).groupBy("q", "k").agg(F.avg("y").alias("p"))
    return per.groupBy("k").agg(F.avg("p").alias("precision"))


def pr_points(pairs: DataFrame) -> DataFrame:
    """(q, recall, precision) at each distinct score, and the start (0, 1)."""
    steps = pairs.groupBy("q", "sim").agg(F.sum("y").alias("yy"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("q").orderBy(F.desc("sim")).rowsBetween(Window.unboundedPreceding, 0)
    s = steps.withColumn("tp", F.sum("yy").over(down)).withColumn("nn", F.sum("n").over(down)).withColumn("pos", F.sum("yy").over(Window.partitionBy("q"))).where("pos > 0")
    points = s.select("q", (F.col("tp") / F.col("pos")).alias("recall"), (F.col("tp") / F.col("nn")).alias("precision"))
    return points.unionByName(points.select("q").distinct().select("q", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")))


def interpolated(xs: DataFrame, points: DataFrame, by: str) -> DataFrame:
    """(by, x, y): piecewise linear interpolation of each curve (by, x, y) at every x of xs; flat beyond its ends."""
    after = Window.partitionBy(by).orderBy("x")
    legs = points.withColumn("x2", F.lead("x").over(after)).withColumn("y2", F.lead("y").over(after)).withColumn("first", F.row_number().over(after) == 1)
    p = legs.select(by, F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", "first")
    inside = (F.col("x") >= F.col("x1")) & (F.col("x2").isNull() | (F.col("x") < F.col("x2")))
    hit = p.join(F.broadcast(xs), inside | (F.col("first") & (F.col("x") < F.col("x1"))))
    slope = F.when(F.col("x2").isNull() | (F.col("x") <= F.col("x1")), F.lit(0.0)).otherwise((F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    return hit.select(by, "x", (F.col("y1") + slope * (F.col("x") - F.col("x1"))).alias("y"))


def mean_pr_curve(pairs: DataFrame, points: int = 100) -> DataFrame:
    """(recall, precision): each query's curve interpolated at evenly spaced recalls, then averaged."""
    best = pr_points(pairs).groupBy("q", "recall").agg(F.max("precision").alias("y")).withColumnRenamed("recall", "x")
    grid = pairs.sparkSession.range(points).select((F.col("id") / float(points - 1)).alias("x"))
    return interpolated(grid, best, "q").groupBy(F.col("x").alias("recall")).agg(F.avg("y").alias("precision"))


# the same over all rows as queries and candidates: scores come from products of blocks, and no pair has a row


def _labelled(rows: DataFrame | FeatureStore, columns: dict[str, Column], size: int) -> tuple[DataFrame, int]:
    """Blocks of rows (id, label and what columns need), or of a store that holds the columns; a null label is relevant to none."""
    if isinstance(rows, FeatureStore):
        return rows.blocks([c.lstrip("*") for c in columns], size)
    return products.packed(rows, columns | label_columns(), size)


def _numbers(rows: DataFrame | FeatureStore, size: int) -> DataFrame | None:
    return rows.numbers(size) if isinstance(rows, FeatureStore) else None


def _relevant(q: products.Arrays, c: products.Arrays) -> np.ndarray:
    same = (q["label"][:, None] == c["label"][None, :]) & q["known"][:, None] & c["known"][None, :]
    return (same & (q["id"][:, None] != c["id"][None, :])).astype(np.int64)


Score = Callable[[products.Arrays, products.Arrays], np.ndarray]


def cosines(q: products.Arrays, c: products.Arrays) -> np.ndarray:
    return products.product(products.unit(q["v"], 0.0), products.unit(c["v"], 0.0))


cosines.parts = ({"v": "plain"}, {"v": 1.0})
cosines.most = 1.0


def relevance_of(q: products.Arrays, c: products.Arrays) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """_relevant() of single pairs (i, j)."""
    return lambda i, j: ((q["label"][i] == c["label"][j]) & q["known"][i] & c["known"][j] & (q["id"][i] != c["id"][j])).astype(np.int64)


def relevant_rows(q: products.Arrays, c: products.Arrays) -> np.ndarray:
    """The sums of _relevant() over c, from how often each label occurs."""
    labels, counts = np.unique(c["label"][c["known"]], return_counts=True)
    if not len(labels):
        return np.zeros(len(q["id"]), dtype=np.int64)
    at = np.minimum(np.searchsorted(labels, q["label"]), len(labels) - 1)
    every = np.where((labels[at] == q["label"]) & q["known"], counts[at], 0)
    i, j = products.same_ids(q, c)
    own = i[(q["label"][i] == c["label"][j]) & q["known"][i] & c["known"][j]]
    return every - np.bincount(own, minlength=len(every))


def top_ranks(rows: DataFrame | FeatureStore, columns: dict[str, Column], score: Score, k: int, places: int = PLACES, size: int = products.SIZE) -> DataFrame:
    """(q, c, rk, sim, y, pos, hits): the first k candidates of each query, as ranked() gives them."""
    blocks, n = _labelled(rows, columns, size)
    parts = getattr(score, "parts", None)
    scores = products.Scores(parts[0], [parts[1]]) if parts else None

    def meet(sums: list, q: products.Arrays, c: products.Arrays) -> list:
        if scores:
            scores.offer(sums[:1], q, c, relevance_of(q, c), places)
        else:
            sums[0].add(products.whole(score(q, c), places), c["id"], _relevant(q, c), q["id"][:, None] == c["id"][None, :])
        sums[1] += relevant_rows(q, c)
        return sums

    def finish(sums: list, q: products.Arrays) -> dict:
        out = sums[0].rows(q["id"], places)
        keep = sums[0].score != np.iinfo(np.int64).min
        return out | {"rk": out["rank"], "pos": np.broadcast_to(sums[1][:, None], keep.shape)[keep], "hits": np.cumsum(sums[0].y, axis=1)[keep]}

    return products.met(blocks, n, lambda q: [products.Best(len(q["id"]), k), np.zeros(len(q["id"]), dtype=np.int64)], meet, finish, "q long, c long, rk long, sim double, y long, pos long, hits long", listed=_numbers(rows, size))


class Counts:
    """Counts of rounded scores, within -top to top, of each query: a task holds these and a few blocks of scores, whatever the
    number of rows. A score's place is 2 * (top - score), and one less for relevant pairs: the best first."""

    def __init__(self, queries: int, top: int):
        self.top, self.bins, self.waiting, self.width = top, 4 * top + 2, [], 0
        self.counts = np.zeros((queries, self.bins), dtype=np.int64 if queries * self.bins < 1 << 20 else np.int32)

    def add(self, scores: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Scores that are whole numbers, which are overwritten, and whether pairs are relevant; the pairs i, j don't count."""
        scores *= -2
        scores += 2 * self.top + 1
        code = scores.astype(np.uint16)
        code -= y
        code[i, j] = self.bins  # beyond all places
        self.waiting.append(code)
        self.width += code.shape[1]
        if self.width >= WAITING:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            for row, counts in zip(np.concatenate(self.waiting, axis=1), self.counts, strict=True):
                counts += np.bincount(row, minlength=self.bins + 1)[: self.bins].astype(counts.dtype)
        self.waiting, self.width = [], 0

    def steps(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, relevant, all) of the queries a to z by their scores that occur, the best first."""
        both = self.counts[a:z].reshape(z - a, -1, 2)
        query, at = np.nonzero(both.any(2))
        yy = both[query, at, 0].astype(np.int64)
        return query, self.top - at, yy, yy + both[query, at, 1]


def _top(score: Score, places: int) -> int | None:
    """The greatest rounded score, as a whole number, where there are few enough to count each."""
    most = getattr(score, "most", None)
    top = None if most is None else math.ceil(most * 10**places)
    return top if top is not None and 4 * top + 2 < BINS else None


def _counted(rows: DataFrame | FeatureStore, columns: dict[str, Column], score: Score, finish: Callable, schema: str, places: int, size: int) -> DataFrame:
    """finish(queries, query, score, relevant, all) of queries' counts by query (its number) and score, best scores first.
    Scores with a bound are counted as blocks meet. Of others a block keeps one whole number for each of its queries and each
    row, and sorts those of a few queries at once."""
    top = _top(score, places)
    if top is not None:
        return _binned(rows, columns, score, finish, schema, places, size, top)
    size = max(16, min(size, ENTRIES // max(1, rows.count())))
    blocks, n = _labelled(rows, columns, size)

    def meet(sums: list, q: products.Arrays, c: products.Arrays) -> list:
        scores = products.whole(score(q, c), places)
        code = 1 - 2 * scores - _relevant(q, c)  # ascending: the best scores, of equal ones the relevant
        i, j = products.same_ids(q, c)
        sums[1].append((i, j + sum(x.shape[1] for x in sums[0])))
        sums[0].append(code.astype(np.int32) if np.abs(scores).max(initial=0) < 1 << 29 else code)
        return sums

    def end(sums: list, q: products.Arrays) -> Iterator[dict]:
        own = [np.concatenate(x) for x in zip(*sums[1], strict=True)]
        step = max(1, SORTED // max(1, sum(x.shape[1] for x in sums[0])))
        for a in range(0, len(q["id"]), step):
            code = np.concatenate([x[a : a + step] for x in sums[0]], axis=1)
            here = (own[0] >= a) & (own[0] < a + step)
            code[own[0][here] - a, own[1][here]] = np.iinfo(code.dtype).max
            code.sort(axis=1)
            valid = code.shape[1] - np.bincount(own[0][here] - a, minlength=len(code))
            query = np.repeat(np.arange(len(code)), valid)
            code = np.concatenate([x[:m] for x, m in zip(code, valid, strict=True)])
            step_of, y = code >> 1, 1 - (code & 1)
            new = np.ones(len(code), dtype=bool)
            new[1:] = (step_of[1:] != step_of[:-1]) | (query[1:] != query[:-1])
            heads = np.flatnonzero(new)
            every = np.diff(np.append(heads, len(code)))
            yy = np.add.reduceat(y.astype(np.int64), heads) if len(heads) else np.empty(0, dtype=np.int64)
            yield finish(products.taken(q, slice(a, a + step)), query[heads], -step_of[heads] / 10.0**places + 0.0, yy, every)

    return products.met(blocks, n, lambda q: [[], []], meet, end, schema, most=1, listed=_numbers(rows, size))


def _binned(rows: DataFrame | FeatureStore, columns: dict[str, Column], score: Score, finish: Callable, schema: str, places: int, size: int, top: int) -> DataFrame:
    blocks, n = _labelled(rows, columns, size)

    def meet(counts: Counts, q: products.Arrays, c: products.Arrays) -> Counts:
        scores = score(q, c)
        scores *= 10.0**places
        np.rint(scores, out=scores)
        if np.isnan(scores.sum()):
            scores = np.nan_to_num(scores)
        y = (q["label"][:, None] == c["label"][None, :]) & (q["known"][:, None] & c["known"][None, :])
        counts.add(scores, y, *products.same_ids(q, c))
        return counts

    def end(counts: Counts, q: products.Arrays) -> Iterator[dict]:
        counts.settle()
        step = max(1, SORTED // counts.bins)
        for a in range(0, len(q["id"]), step):
            query, at, yy, every = counts.steps(a, min(a + step, len(q["id"])))
            yield finish(products.taken(q, slice(a, a + step)), query, at / 10.0**places + 0.0, yy, every)

    return products.met(blocks, n, lambda q: Counts(len(q["id"]), top), meet, end, schema, most=1, listed=_numbers(rows, size))


def _running(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums up to each row, within its query."""
    total = np.cumsum(x)
    heads = np.flatnonzero(np.diff(query, prepend=-1))
    return total - np.repeat(total[heads] - x[heads], np.diff(np.append(heads, len(x))))


def _totals(query: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(query, weights=x, minlength=n)


def all_ap_full(rows: DataFrame | FeatureStore, columns: dict[str, Column], score: Score, places: int = PLACES, size: int = COUNTED) -> DataFrame:
    """ap_full() of all pairs of rows."""
    if _top(score, places) is None:
        return _sorted_aps(rows, columns, score, places, size)

    def finish(q: products.Arrays, query: np.ndarray, sim: np.ndarray, yy: np.ndarray, every: np.ndarray) -> dict:
        n = len(q["id"])
        pos, tp, nn = _totals(query, yy, n), _running(query, yy), _running(query, every)
        ap, have = _totals(query, yy / np.maximum(pos[query], 1) * tp / nn, n), pos > 0
        return {"q": q["id"][have], "ap": ap[have]}

    return _counted(rows, columns, score, finish, "q long, ap double", places, size)


def _sorted_aps(rows: DataFrame | FeatureStore, columns: dict[str, Column], score: Score, places: int, size: int) -> DataFrame:
    """(q, ap) by scores that are too many to count: a task holds a whole number for each row and each of a few queries (fewer as
    rows grow), sorts them once, and then looks up where the relevant ones' scores end. Blocks are read as they were packed."""
    n = rows.count()
    path, known = shared.by_number(_labelled(rows, columns, products.SIZE)[0], "block", "met")
    parts = -(-(n // max(1, len(known)) + 1) // max(16, min(size, ENTRIES // max(1, n))))
    given = getattr(score, "parts", None)
    scored = products.weighted(*given, score, places) if given else lambda q, c: products.whole(score(q, c), places, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda number: (products.loaded(x) for x in shared.read_number(path, number, "payload"))
        for at in (x for b in batches for x in b.column(0).to_pylist()):
            for block in read(known[at // parts]):
                q = pieces(block, parts)[at % parts]
                if len(q["id"]):
                    ap = _aps_of(q, (c for number in known for c in read(number)), scored)
                    yield pa.RecordBatch.from_pydict({"q": q["id"][~np.isnan(ap)], "ap": ap[~np.isnan(ap)]})

    tasks = len(known) * parts
    spark = rows.spark if isinstance(rows, FeatureStore) else rows.sparkSession
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, "q long, ap double")


def _aps_of(q: products.Arrays, candidates: Iterator[products.Arrays], scored: Score) -> np.ndarray:
    """Each query's average precision over all candidates but itself, by scores that are whole numbers; NaN without relevant ones."""
    held = []
    for c in candidates:
        values = np.unique(q["label"][q["known"]])
        mine, theirs = (np.where(x["known"] & np.isin(x["label"], values), np.searchsorted(values, x["label"]), other).astype(np.int16) for x, other in ((q, -1), (c, -2)))
        code = scored(q, c)  # ascending: the best scores, of equal ones the relevant, which are even
        code *= -2
        code += mine[:, None] != theirs[None, :]
        code[products.same_ids(q, c)] = np.iinfo(np.int32).max  # odd, and beyond all scores
        held.append(code)
    ap, step = np.full(len(q["id"]), np.nan), max(1, SORTED // max(1, sum(x.shape[1] for x in held)))
    for a in range(0, len(ap), step):
        codes = np.concatenate([x[a : a + step] for x in held], axis=1)
        codes.sort(axis=1)
        for i, row in enumerate(codes, a):
            relevant = row[(row & 1) == 0]
            if len(relevant):
                ends = np.append(np.flatnonzero(relevant[1:] != relevant[:-1]), len(relevant) - 1)  # of equal scores
                tp, nn = ends + 1, np.searchsorted(row, relevant[ends] + np.int32(1), "right")
                ap[i] = (np.diff(tp, prepend=0) / len(relevant) * tp / nn).sum()
    return ap


def all_pr_points(rows: DataFrame, columns: dict[str, Column], score: Score, places: int = PLACES, size: int = COUNTED) -> DataFrame:
    """pr_points() of all pairs of rows."""

    def finish(q: products.Arrays, query: np.ndarray, sim: np.ndarray, yy: np.ndarray, every: np.ndarray) -> dict:
        pos, tp, nn = _totals(query, yy, len(q["id"])), _running(query, yy), _running(query, every)
        keep, start = pos[query] > 0, np.flatnonzero(pos > 0)
        return {"q": np.concatenate([q["id"][query[keep]], q["id"][start]]), "recall": np.concatenate([tp[keep] / pos[query[keep]], np.zeros(len(start))]), "precision": np.concatenate([tp[keep] / nn[keep], np.ones(len(start))])}

    return _counted(rows, columns, score, finish, "q long, recall double, precision double", places, size)


def all_mean_pr_curve(rows: DataFrame, columns: dict[str, Column], score: Score, points: int = 100, places: int = PLACES, size: int = COUNTED) -> DataFrame:
    """mean_pr_curve() of all pairs of rows: each block gives the sums of its queries' curves."""

    def finish(q: products.Arrays, query: np.ndarray, sim: np.ndarray, yy: np.ndarray, every: np.ndarray) -> dict:
        pos, tp, nn = _totals(query, yy, len(q["id"])), _running(query, yy), _running(query, every)
        grid, total, curves = np.arange(points) / float(points - 1), np.zeros(points), 0
        for a, z in zip(heads := np.flatnonzero(np.diff(query, prepend=-1)), np.append(heads[1:], len(query)), strict=True):
            if p := pos[query[a]]:
                x, first = np.unique(np.append(0.0, tp[a:z] / p), return_index=True)
                y = np.maximum.reduceat(np.append(1.0, tp[a:z] / nn[a:z]), first)  # recalls don't fall, so equal ones are together
                total, curves = total + np.interp(grid, x, y), curves + 1
        return {"recall": grid, "total": total, "curves": np.full(points, curves)}

    sums = _counted(rows, columns, score, finish, "recall double, total double, curves long", places, size)
    return sums.groupBy("recall").agg((F.sum("total") / F.sum("curves")).alias("precision"))


def separation_sample(pairs: DataFrame, seed: int = 42, factor: int = 2) -> DataFrame:
    """All relevant pairs, and per query `factor` times as many others, chosen by a seeded hash."""
    w = Window.partitionBy("q").orderBy(F.xxhash64(F.lit(seed), "q", "c"), "c")
    others = pairs.withColumn("pos", F.sum("y").over(Window.partitionBy("q"))).where("y = 0 and pos > 0").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= factor * F.col("pos")).drop("__n", "pos")
    return pairs.where("y = 1").unionByName(others)


_P = [np.uint64(p) for p in (0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P[2]
    h = (h ^ (h >> np.uint64(29))) * _P[3]
    return h ^ (h >> np.uint64(32))


def _hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of whole numbers (long) after what gave `seed`; both of type uint64."""
    h = (seed + _P[5] + np.uint64(8)) ^ (_turned(x * _P[2], 31) * _P[1])
    return _mixed(_turned(h, 27) * _P[1] + _P[4])


def _hashed_seed(seed: int) -> np.ndarray:
    """Spark's xxhash64 of a literal int."""
    h = (np.array([42], dtype=np.uint64) + _P[5] + np.uint64(4)) ^ (np.array([seed], dtype=np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * _P[1]
    return _mixed(_turned(h, 23) * _P[2] + _P[3])


def all_separation_sample(queries: DataFrame, rows: DataFrame, seed: int = 42, factor: int = 2) -> DataFrame:
    """(q, c, y): the pairs of separation_sample() of queries with all rows (both id, label) but themselves, of queries with relevant rows.

    A task holds a block of queries and reads the blocks of rows twice: first it counts relevant rows, and the others by the
    first bits of their hashes; then it gives what lies before the bits where a query's number is reached, and ranks only
    the few others of these bits. No pair is shuffled or sorted."""
    path, numbers = shared.by_number(products.packed(rows.where("id is not null"), label_columns())[0], "block", "rows")
    asked, n = products.packed(queries.where("id is not null"), label_columns(), SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payload in (x for b in batches for x in b.column("payload").to_pylist()):
            q = products.loaded(payload)
            size, start = len(q["id"]), _hashed(q["id"].astype(np.uint64), _hashed_seed(seed))

            def met(q: products.Arrays = q, start: np.ndarray = start) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
                for number in numbers:
                    for x in shared.read_number(path, number, "payload"):
                        c = products.loaded(x)
                        y = (q["label"][:, None] == c["label"][None, :]) & q["known"][:, None] & c["known"][None, :]
                        other = ~y & q["known"][:, None] & c["known"][None, :]
                        i, j = products.same_ids(q, c)
                        y[i, j] = other[i, j] = False
                        h = _hashed(c["id"].astype(np.uint64)[None, :], start[:, None]) ^ np.uint64(1 << 63)  # in the order of longs
                        yield c["id"], y, other, h

            pos, counts = np.zeros(size, dtype=np.int64), np.zeros((size, FIRST), dtype=np.int64)
            for _, y, other, h in met():
                pos += y.sum(1)
                at = (h >> np.uint64(64 - BITS)).astype(np.int64) + np.arange(size)[:, None] * FIRST
                counts += np.bincount(at[other], minlength=size * FIRST).reshape(size, FIRST)
            want, upto = factor * pos, np.cumsum(counts, axis=1)
            cut = (upto < want[:, None]).sum(1)  # the bits where a query's number is reached; FIRST if it never is
            left = want - np.where(cut > 0, np.take_along_axis(upto, np.maximum(cut - 1, 0)[:, None], 1)[:, 0], 0)
            last: list[list[np.ndarray]] = [[], [], []]
            for ids, y, other, h in met():
                bits = (h >> np.uint64(64 - BITS)).astype(np.int64)
                i, j = np.nonzero(y | (other & (bits < cut[:, None])))
                yield pa.RecordBatch.from_pydict({"q": q["id"][i], "c": ids[j], "y": y[i, j].astype(np.int32)})
                i, j = np.nonzero(other & (bits == cut[:, None]))
                for kept, new in zip(last, (i, h[i, j], ids[j]), strict=True):
                    kept.append(new)
            i, h, ids = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in last)
            order = np.lexsort((ids, h, i))
            i, ids = i[order], ids[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < left[i]
            yield pa.RecordBatch.from_pydict({"q": q["id"][i[keep]], "c": ids[keep], "y": np.zeros(keep.sum(), dtype=np.int32)})

    return asked.repartition(n, "block").mapInArrow(run, "q long, c long, y int")


def relevance(sims: DataFrame, labels: DataFrame) -> DataFrame:
    """sims (q, c, sim) with y from labels (id, label): 1 for another row of the same label."""
    a, b = labels.select(F.col("id").alias("q"), F.col("label").alias("la")), labels.select(F.col("id").alias("c"), F.col("label").alias("lb"))
    same = F.coalesce((F.col("la") == F.col("lb")) & (F.col("q") != F.col("c")), F.lit(False))
    return sims.join(a, "q", "left").join(b, "c", "left").select("q", "c", "sim", same.cast("int").alias("y"))


def labels_per_query(labels: DataFrame, images: DataFrame) -> DataFrame:
    """The mean over all images (id) of how many others share their label; images without a label count 0."""
    n = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    per = images.join(labels, "id", "left").join(n, "label", "left")
    return per.agg(F.avg(F.coalesce("n", F.lit(0))).alias("avg_labels"))


def report(aps: DataFrame, queries: DataFrame, split: float = 0.5, cells: int = 1000) -> DataFrame:
    """(side, rank, q, ap): every query (q), those without relevant candidates with AP 0; ranks count from the worst and
    from the best before queries are dealt into worst (below split) and best. Queries are ranked within cells of equal AP
    ranges; only the cells' counts meet."""
    every = queries.join(aps, "q", "left").select("q", F.coalesce("ap", F.lit(0.0)).alias("ap")).withColumn("cell", F.floor(F.col("ap") * cells))
    counts = every.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.orderBy("cell")  # cells + 1 rows at most
    front = counts.select(F.col("cell").alias("c"), F.coalesce(F.sum("n").over(all_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("front"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    r = every.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("ap", "q"))).join(front, F.col("cell") == F.col("c"))
    worst, low = F.col("front") + F.col("r"), F.col("ap") < split
    return r.select(F.when(low, "worst").otherwise("best").alias("side"), F.when(low, worst).otherwise(F.col("total") + 1 - worst).cast("long").alias("rank"), "q", "ap")


def pareto(trials: DataFrame) -> DataFrame:
    """(n, score): the best score by number of active features, where it beats all smaller numbers'."""
    best = trials.groupBy("n").agg(F.max("score").alias("score"))
    before = F.max("score").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))  # one row a number of features
    return best.withColumn("before", before).where("before is null or score > before").select("n", "score")


def exported(aps: DataFrame, members: DataFrame, listing: DataFrame, least: float = 0.5) -> DataFrame:
    """The manifest of well-answered clusters: (cluster_key, pos, file_name, path). aps has q as the query's file name
    (a cluster's member 0); a path is looked up by the full name, then by the base name."""
    from lumigrid.functions import names

    good = members.where("pos = 0").join(aps.where(F.col("ap") >= least), F.col("file_name") == F.col("q"), "left_semi").select("cluster_key")
    full = listing.select(F.col("path").alias("__full")).distinct()
    base = listing.groupBy(names.basename(F.col("path")).alias("__base")).agg(F.min("path").alias("__path"))
    rows = members.join(good, "cluster_key", "left_semi").join(full, F.col("file_name") == F.col("__full"), "left").join(base, names.basename(F.col("file_name")) == F.col("__base"), "left")
    return rows.select("cluster_key", "pos", "file_name", F.coalesce("__full", "__path", "file_name").alias("path"))
