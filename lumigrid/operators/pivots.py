"""Exact nearest neighbours by inner products of blocks, without the pairs of blocks that can't hold any.

Vectors are dealt to the nearest of a bounded number of pivots, and a pivot's vectors are cut into blocks of a bounded
size, so blocks are compact: each has a centre and a radius. First each block meets itself, which gives each query k
candidates and so a score that others must reach. By the triangle inequality no product of blocks a and b exceeds
c_a . c_b + r_a |c_b| + r_b |c_a| + r_a r_b; where that is below what every query of both has, or is promised by the same
bound from below by some block of k rows, the pair is left out. For what remains, a task reads the partners of a block from
the shared folder, one after the other, and keeps each query's k best: only numbers of blocks are shuffled, and what comes
out are k rows a query. Pivots and blocks save work; any choice gives the same neighbours.

The bounds of blocks are found between chunks of CHUNK blocks, so no task holds all blocks' centres.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.operators import products
from lumigrid.sources import shared

#: Pivots at most, rows sampled for each, and blocks whose centres meet in a task.
PIVOTS, SAMPLED, CHUNK = 1024, 8, 1024
#: The share of pairs beyond which bounds save too little: full blocks, which are fewer, all meet then.
CROWDED = 0.5
LEAST = np.iinfo(np.int64).min
NEAR = "q long, c long, rank long, sim double"


def _saved(arrays: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def _loaded(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as held:
        return dict(held)


def _rows_of(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def spread(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """At most n pivots of a sample of distinct vectors: each the farthest from those before, then a few means."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    out = sample[chosen].copy()
    for _ in range(rounds):
        near = ((out * out).sum(1)[None, :] - 2 * (sample @ out.T)).argmin(1)
        sums, counts = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(sums, near, sample)
        out[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return out


def dealt(rows: DataFrame, n: int, size: int, epsilon: float) -> DataFrame:
    """(pivot, part, id, v array<double>): unit vectors with their nearest pivot, which is cut into parts of about `size`."""
    unit = lambda x: products.unit(x, epsilon)
    wanted = min(PIVOTS, 2 * n)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * wanted).collect()
    pivots = spread(np.unique(unit(np.array([r["v"] for r in sample], dtype=np.float64)), axis=0), wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = unit(_rows_of(b))
                near = ((pivots * pivots).sum(1)[None, :] - 2 * (v @ pivots.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("id"), pa.array(list(v), pa.list_(pa.float64()))], ["pivot", "id", "v"])

    near = shared.written(rows.mapInArrow(run, "pivot int, id long, v array<double>"), "pivots")
    counts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))  # PIVOTS rows at most
    return near.join(F.broadcast(counts), "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")


def blocks(rows: DataFrame, k: int, places: int) -> tuple[DataFrame, str]:
    """(block, bound), and the folder with each block's payload, for shared.read_number(): ids, vectors and the best of its own
    rows; bound: centre, radius, length of the centre, the least score that its queries must reach and the number of rows."""

    def one(whole: pa.Table) -> pa.Table:
        whole = whole.sort_by("id")
        ids, v = whole.column("id").to_numpy(), _rows_of(whole.combine_chunks().to_batches()[0])
        best = products.Best(len(ids), k)
        for at in range(0, len(ids), products.SIZE):  # a crowded part may exceed a block
            best.add(products.whole(products.product(v, v[at : at + products.SIZE]), places), ids[at : at + products.SIZE])
        reach = best.score[:, k - 1] if best.score.shape[1] >= k else np.full(len(ids), LEAST)
        centre = v.mean(0)
        radius = np.sqrt(((v - centre) ** 2).sum(1).max())
        bound = np.concatenate([centre, [radius, np.linalg.norm(centre), float(reach.min()), len(ids)]])
        block = (int(whole.column("pivot")[0].as_py()) << 32) | int(whole.column("part")[0].as_py())
        payload = _saved({"id": ids, "v": v, "best": best.id, "score": best.score})
        return pa.table({"block": pa.array([block]), "payload": pa.array([payload], pa.binary()), "bound": pa.array([bound.tolist()])})

    path, _ = shared.by_number(rows.groupBy("pivot", "part").applyInArrow(one, "block long, payload binary, bound array<double>"), "block", "blocks")
    return rows.sparkSession.read.schema("block long, bound array<double>").parquet(path), path


def _chunks(bounds: DataFrame, chunks: int) -> DataFrame:
    """(x, y): bounds of blocks, CHUNK or so together, each chunk with itself and every later one."""

    def packed(whole: pa.Table) -> pa.Table:
        return pa.table({"chunk": whole.column("chunk").slice(0, 1), "payload": pa.array([_saved({"block": whole.column("block").to_numpy(), "bound": np.array(whole.column("bound").to_pylist())})], pa.binary())})

    held = shared.written(bounds.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).groupBy("chunk").applyInArrow(packed, "chunk int, payload binary"), "bounds")
    left = held.select(F.col("payload").alias("x"), F.explode(F.sequence(F.col("chunk"), F.lit(chunks - 1))).alias("j"))
    return left.join(held.select(F.col("chunk").alias("j"), F.col("payload").alias("y")), "j").select("x", "y").repartition(min(1024, chunks * (chunks + 1) // 2))


def _reach(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the centres, how far products of vectors may be from them, and which pairs are of different blocks."""
    (ca, ra, na), (cb, rb, nb) = ((m[:, :-4], m[:, -4], m[:, -3]) for m in (a["bound"], b["bound"]))
    return ca @ cb.T, ra[:, None] * nb[None, :] + na[:, None] * rb[None, :] + ra[:, None] * rb[None, :], a["block"][:, None] != b["block"][None, :]


def raised(bounds: DataFrame, k: int, chunks: int, places: int) -> DataFrame:
    """bounds with higher scores to reach where another block of k rows or more is near enough to promise them."""
    slack = 10.0**-places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = _loaded(x), _loaded(y)
                middle, off, other = _reach(a, b)
                low = np.where(other, np.floor((middle - off - slack) * 10.0**places), float(LEAST))
                for block, least in ((a["block"], np.where(b["bound"][None, :, -1] >= k, low, float(LEAST)).max(1)), (b["block"], np.where(a["bound"][:, None, -1] >= k, low, float(LEAST)).max(0))):
                    yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "low": pa.array(least)})

    best = _chunks(bounds, chunks).mapInArrow(run, "block long, low double").groupBy("block").agg(F.max("low").alias("low"))
    at = F.size("bound") - 2
    higher = F.transform("bound", lambda x, i: F.when(i == at, F.greatest(x, F.col("low"))).otherwise(x))
    return bounds.join(best, "block").select("block", higher.alias("bound"))


def pairs(bounds: DataFrame, k: int, places: int) -> DataFrame:
    """(a, b) of the pairs of different blocks, each once, in which some query may still find a neighbour."""
    chunks = max(1, -(-bounds.count() // CHUNK))
    slack = 10.0**-places  # scores are rounded, and sums of doubles are near theirs only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = _loaded(x), _loaded(y)
                middle, off, other = _reach(a, b)
                i, j = np.nonzero(other & ((middle + off + slack) * 10.0**places >= np.minimum(a["bound"][:, None, -2], b["bound"][None, :, -2])))
                p, q = a["block"][i], b["block"][j]
                if x == y:
                    p, q = p[p < q], q[p < q]
                yield pa.RecordBatch.from_pydict({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

    return shared.written(_chunks(raised(bounds, k, chunks, places), chunks).mapInArrow(run, "a long, b long"), "block-pairs")


def _no_label(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.zeros(np.shape(i), dtype=np.int64)


def found(bounds: DataFrame, path: str, pairs_: DataFrame, k: int, places: int) -> DataFrame:
    """NEAR of each block's queries, from its own rows and those of its partners."""
    scores = products.Scores({"v": "product"}, [{"v": 1.0}])

    def read(block: int) -> dict[str, np.ndarray]:
        return _loaded(next(shared.read_number(path, block, "payload")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, best = None, None
        told = lambda: pa.RecordBatch.from_pydict({x: got[x] for got in [best.rows(mine["id"], places)] for x in ("q", "c", "rank", "sim")})
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b is None:  # a's own row comes first
                    if best is not None:
                        yield told()
                    mine, best = read(a), products.Best(0, k)
                    best.id, best.score, best.y = mine["best"], mine["score"], np.zeros_like(mine["best"])
                else:
                    scores.offer([best], mine, read(b), _no_label, places, selves=True)
        if best is not None:
            yield told()

    both = pairs_.unionByName(pairs_.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = bounds.select(F.col("block").alias("a"), F.lit(None).cast("long").alias("b"))
    met = own.unionByName(both).repartition(min(1024, max(1, bounds.count())), "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return met.mapInArrow(meet, NEAR)


def neighbours(rows: DataFrame, n: int, k: int, size: int = products.SIZE, places: int = 6, epsilon: float = 1e-9, told: Callable[[int], None] | None = None) -> DataFrame:
    """(q, c, rank, sim): each row's k best of rows (id, v array<double> of one length, none null) by cosine, itself included;
    sims are rounded and ties go to the lower id. n: about how many blocks there will be; told gets the number of pairs of
    different blocks that are met."""
    bounds, path = blocks(dealt(rows, n, size, epsilon), k, places)
    left, every = pairs(bounds, k, places), bounds.count()
    met = left.count()
    if told:
        told(met)
    if met > CROWDED * every * (every - 1) / 2:
        return unpruned(rows, k, size, places, epsilon)
    return found(bounds, path, left, k, places)


def unpruned(rows: DataFrame, k: int, size: int = products.SIZE, places: int = 6, epsilon: float = 1e-9) -> DataFrame:
    """neighbours() by all pairs of full blocks, of which a task holds several."""
    blocks_, n = products.packed(rows, {"v": F.col("v")}, size)
    units = lambda x: {"id": x["id"], "v": products.unit(x["v"], epsilon)}
    scores = products.Scores({"v": "product"}, [{"v": 1.0}])

    def meet(best: products.Best, q: products.Arrays, c: products.Arrays) -> products.Best:
        scores.offer([best], units(q), units(c), _no_label, places, selves=True)
        return best

    return products.met(blocks_, n, lambda q: products.Best(len(q["id"]), k), meet, lambda best, q: best.rows(q["id"], places), NEAR)
