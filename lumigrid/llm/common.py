"""What the training-data operators share: the shared work folder, written tables, words, and gapless ranks.

All operators read only the columns they name (an id and a text), so extra columns of any name in the input
never clash with what they add.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumigrid.sources import shared

#: Words are runs of anything but these characters.
WORD_BREAKS = "\\x20\\x09-\\x0D"
#: Spark's setting by which a query's shuffle files go when it ends, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared.folder(spark)}/lumigrid/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written inside a with-block; leaving it deletes all but those that keep() named."""

    open_: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.open_.append(self)
        return self

    def __exit__(self, *_) -> None:
        self.open_.remove(self)
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        files = df.inputFiles()[:1]
        self.paths = [p for p in self.paths if not (files and p.rsplit("/", 1)[1] in files[0])]
        return df


def _told(path: str) -> str:
    if Scratch.open_:
        Scratch.open_[-1].paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. This cuts the lineage: a lost executor costs no recomputation. What was
    shuffled for it is deleted as soon as it is written."""
    spark = df.sparkSession
    path = _told(fresh_path(spark, name))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a Parquet table in the shared folder, bucketed by key: later groupings by key shuffle the other side only."""
    spark, table = df.sparkSession, f"lumigrid_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", _told(fresh_path(spark, name))).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/lumigrid/" in file:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: what a task makes of their texts is short-lived."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's own, which are made for short rows: texts are long. Settings of the user's stay."""
    for key, usual, value in (("maxRecordsPerBatch", ("10000",), "1000"), ("maxBytesPerBatch", ("67108864b", "64MB"), "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual[0]) in usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones; every other column is left behind."""
    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def n_words(text: Column) -> Column:
    """How many runs of characters other than the word breaks a text has."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(F.trim(flat) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(flat), " +"))).cast("long")


def crc_mod(id_col: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, cells: int = 256) -> DataFrame:
    """Adds out: 0, 1, 2 ... within each group, in an order fixed by (cell, order).

    Each group is dealt into cells by a hash of the order columns. Counts per cell are summed up in front (a small
    table of at most groups x cells rows), and rows are numbered within their cell: no task holds a whole group.
    Rows that agree in all order columns are interchangeable; the group columns must not be null.
    """
    cell, base = "__cell", "__base"
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sums = dealt.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(cell).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    on = F.col(cell) == F.col("__c")
    for g in group:  # plain equality, so that the join finds the rows where the window has put them
        on = on & (F.col(g) == F.col(f"__{g}"))
    inside = Window.partitionBy(*group, cell).orderBy(*order)
    ranked = dealt.withColumn("__r", F.row_number().over(inside))
    return ranked.join(sums, on).withColumn(out, (F.col(base) + F.col("__r") - 1).cast("long")).drop(cell, base, "__r", "__c", *[f"__{g}" for g in group])
