"""Mixing sources to target weights by Efraimidis-Spirakis sampling, from DataFrame functions only.

A source's target is its weight's share of all words, capped at a multiple of what it has; the excess is shared anew by
weight. A source first gives whole epochs; the fraction that remains is filled in the order of exponential keys
-ln(u) / quality, where u is a hash of the document's id, so that reruns agree. Keys are dealt into cells in which
documents of high and of low quality are spread alike, sums of cells are added up in front, and words are prefix-summed within a cell only: no task holds a source.

Defined results: a null text has size 0; a document without words is never taken; null is a source of its own, the
last; sources without words get target 0; repeated rows are taken one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumigrid.llm import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
CELLS = 1024
#: Qualities from the least to the greatest; keys of documents of any of them spread over the cells.
GRADES = (0.05, 0.1, 0.2, 0.5, 1.0)
#: Characters that speak against a text, for its quality weight.
NOISE = "#*$%&|<>!{}[]\\^~=0123456789"


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: less for texts rich in symbols and digits."""
    share = (F.length(text) - F.length(F.translate(text, NOISE, ""))) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - 4.0 * share)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with target: one row for each source, so the windows over all of them are small.

    Sorted by what a unit of weight can get, sources are capped one after the other while their cap is at most the
    level that the rest would share; from the first that is not, all get that level by their weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    df = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    df = df.withColumn("room", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    df = df.withColumn("level", (F.col("total") - before) / after)
    free = F.max(F.when(F.col("room") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("room") <= F.col("level"), F.col("cap")).otherwise(F.least(F.col("cap"), free * F.col("weight")))
    return df.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and a struct `row` of the columns named in keep.

    taken counts words with repeats; the document at the edge of a source's budget gives the words that are missing.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []
    # a 53-bit fraction strictly between 0 and 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), 11).cast("double") + 0.5) / float(2**53)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.n_words(text).alias("size"), (-F.log(u) / quality(text)).alias("key"), *kept)
    # a key without nulls: plain equality lets the join find the rows where the window has put them
    base = base.withColumn("from", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))))
    share = sum((1 - F.exp(-q * F.col("key")) for q in GRADES), F.lit(0.0)) / len(GRADES)
    base = base.withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(share * CELLS)).cast("int"))
    sums = common.written(base.groupBy("from", "source", "cell").agg(F.sum("size").alias("words")), "mix-cells")  # at most sources x CELLS rows
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    front = F.coalesce(F.sum("words").over(Window.partitionBy("from").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = sums.withColumn("front", front).alias("c").join(targets(sizes).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    cells = cells.select(F.col("c.from").alias("__from"), F.col("c.cell").alias("__cell"), "front", "source_size", "target")
    inside = Window.partitionBy("from", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = running.join(cells, (F.col("from") == F.col("__from")) & (F.col("cell") == F.col("__cell")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("front") - F.col("inside")))
    taken = (epochs * F.col("size") + part).cast("long").alias("taken")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken, *(["row"] if keep else []))


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; a document taken in part counts as whole from half on."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    out = mix(docs, seed, keep=docs.columns).withColumn("times", times).where(F.col("times") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
