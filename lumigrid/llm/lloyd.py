"""Vector codes by product quantisation, with Lloyd rounds maintained by differences.

A vector is cut into parts; each part position has a codebook, and a vector's code is the nearest entry of each part.
Components are whole numbers, so sums are exact and the codebooks don't depend on how rows are dealt out.

Each round reads the state of the last one, a row for each vector with its components and its assignment, and writes the
next state. A task adds up what its rows change: plus a part's components for its new entry, minus for its old one, only
where the assignment changed. Those few rows (entries x parts a task at most) are all that is shuffled; they are added to
the running sums and counts of the entries, a table of its own. The driver holds the codebooks alone: parts x entries x
width numbers, bounded by parameters.

Defined results: vectors that are null or hold null or non-finite components are left out. Vectors of unlike lengths are
filled with zeros to the longest, and that to a multiple of the parts; empty vectors are all zeros. Numbers beyond what
squared distances allow (2^31 / sqrt(dimensions), so 2^28 for 64) count as that bound. Repeated rows are rows; of a
repeated id the least vector starts an entry; a null id starts none. Fewer ids than entries give smaller codebooks; with
rows but no id at all there is nothing to start from, and one entry of zeros stands in. An empty table gives an empty
result. Labels of any type, null ones together. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The code byte of a part that has no assignment yet; codebooks hold fewer entries.
NONE = 255


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, x array<int>) of the vectors that count, and how many components each part has."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    held = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    held = held.where(v.isNotNull() & finite)
    longest = held.agg(F.max(F.size(v))).first()[0] or 0
    width = max(1, -(-longest // parts))
    most = math.isqrt(2**62 // (width * parts)) // 2
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    zeros = F.array_repeat(F.lit(0), F.lit(width * parts) - F.size(v))
    return held.select("vec_id", "label", F.concat(x, zeros).alias("x")), width


def first_entries(rows: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids. An id that repeats more often than there
    are entries costs another look beyond it, never a wrong entry."""
    known = rows.where(F.col("vec_id").isNotNull())
    found: dict = {}
    while len(found) < entries:
        beyond = known.where(F.col("vec_id") > F.lit(max(found))) if found else known
        more = beyond.orderBy("vec_id", "x").limit(entries).collect()
        if not more:
            break
        for r in more:
            if len(found) < entries:
                found.setdefault(r["vec_id"], r["x"])
    chosen = [x for _, x in sorted(found.items())] or [[0] * (parts * width)]
    return np.array(chosen, dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For x (rows x parts x width) the nearest entry of each part, the lower of ties, and its squared distance; exact."""
    codes, far = np.empty(x.shape[:2], dtype=np.uint8), np.empty(x.shape[:2], dtype=np.int64)
    most = int(max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * x.shape[2] * most * most < 2**53 else np.int64  # whole numbers below 2^53 are exact as doubles
    for p, book in enumerate(books.astype(kind)):
        v = x[:, p].astype(kind)
        d = (v * v).sum(1)[:, None] - 2 * (v @ book.T) + (book * book).sum(1)[None, :]
        codes[:, p] = at = d.argmin(1)
        far[:, p] = d[np.arange(len(d)), at]
    return codes, far


def _parts_of(b: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, books.shape[0], books.shape[2])


def _bytes(codes: np.ndarray) -> pa.Array:
    raw, n = np.ascontiguousarray(codes).tobytes(), codes.shape[1]
    return pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary())


def _state(rows: DataFrame) -> T.StructType:
    head = [T.StructField(n, rows.schema[n].dataType) for n in ("vec_id", "label")]
    tail = "x array<int>, code binary, part int, entry int, n long, sums array<bigint>"
    return T.StructType(head + T.StructType.fromDDL(tail).fields)


def moved(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The next state: every row with its nearest entries, and for each task rows (part, entry, n, sums) of what changed."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        kinds = None
        for b in batches:
            if not b.num_rows:
                continue
            x, before = _parts_of(b, books), b.column("code").to_pylist()
            old = np.array([np.frombuffer(c, dtype=np.uint8) if c is not None else np.full(parts, NONE, dtype=np.uint8) for c in before]).reshape(-1, parts)
            new, _ = nearest(x, books)
            for codes, sign, which in ((new, 1, new != old), (old, -1, (new != old) & (old != NONE))):
                row, part = np.nonzero(which)
                np.add.at(n, (part, codes[row, part]), sign)
                np.add.at(sums, (part, codes[row, part]), sign * x[row, part])
            kinds = [b.schema.field(i).type for i in (0, 1, 2)]
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _bytes(new), *none], names)
        part, entry = np.nonzero((n != 0) | (sums != 0).any(2))
        if len(part):
            none = [pa.nulls(len(part), t) for t in (*kinds, pa.binary())]
            told = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *told], names)

    schema = _state(state)
    names = schema.names
    return state.mapInArrow(run, schema)


def added(changes: DataFrame, before: DataFrame | None, width: int) -> DataFrame:
    """Running counts and sums (part, entry, n, sums) after these changes."""
    all_ = changes if before is None else changes.unionByName(before)
    return all_.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error long) of all vectors that count, as a written table, and the codebooks
    (parts x entries x width). Rounds end early when the codebooks stand still: later ones could change nothing."""
    if not 0 < entries < NONE:
        raise ValueError(f"1 to {NONE - 1} entries")
    with common.Scratch(vectors.sparkSession) as scratch:
        rows, width = whole(vectors, id_col, vector_col, label_col, parts, scale)
        books = first_entries(rows, parts, width, entries)
        state, sums = rows.withColumn("code", F.lit(None).cast("binary")), None
        last = None
        for _ in range(rounds):
            after = common.written(moved(state, books), "lloyd-state")
            sums = common.written(added(after.where("part is not null").select("part", "entry", "n", "sums"), sums, width), "lloyd-sums")
            if last is not None:
                common.dropped(last)
            last, state = after, after.where("part is null").select("vec_id", "label", "x", "code")
            next_ = books.copy()
            for r in sums.where("n > 0").collect():
                next_[r["part"], r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
            if (next_ == books).all():
                break
            books = next_
        return scratch.keep(common.written(coded(state, books), "lloyd-codes")), books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, x) under these codebooks."""
    schema = T.StructType([*_state(rows).fields[:2], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, far = nearest(_parts_of(b, books), books)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _bytes(codes), pa.array(far.sum(1))], schema.names)

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def restored(code: bytes, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middle of each component's step."""
    return (np.concatenate([books[p, e] for p, e in enumerate(code)]) + 0.5) / scale


def spelled(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256.

    Errors are summed by label in a small table. It is written first, so that its size is known: Spark broadcasts it under
    its own bound, and otherwise splits a hot label's rows."""
    codes, books = fitted(vectors)
    with common.Scratch(vectors.sparkSession) as scratch:
        total = F.sum(F.col("error").cast("decimal(20,0)"))
        sums = scratch.keep(common.written(codes.groupBy("label").agg(F.least(total, F.lit(2**63 - 1).cast("decimal(30,0)")).cast("long").alias("label_error")), "lloyd-labels"))
    sums = sums.withColumnRenamed("label", "of")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(spelled(books)).alias("codebooks_sha256"))
