"""Tables that are looked up by key: files sorted by ranges of one key, with Bloom filters for the others.

A row group has the bounds of its sort key, and a Bloom filter of each other key, so a look-up by either reads the row
groups that may hold it and no others. The table is written once; which row groups are read is the reader's decision, by
the filters that Spark pushes down.

Defined results: null keys are never found; repeated keys give every row; an empty table finds nothing; extra columns
are kept and read only if they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group at most, of a file at most, and keys that are pushed down as single comparisons.
GROUP, FILE, PUSHED = 100_000, 5_000_000, 64


def clustered(df: DataFrame, path: str, key: str, blooms: tuple[str, ...] = (), group: int = GROUP, file: int = FILE, wrong: float = 0.01) -> None:
    """Writes df to path, sorted by key in files of disjoint ranges; blooms: columns with a Bloom filter a row group, each of
    which answers wrongly with this probability that a value may be there."""
    n = max(1, -(-df.count() // file))
    writer = df.repartitionByRange(n, key).sortWithinPartitions(key).write
    # pages are counted too, so that a small group is not closed later than it should be
    writer = writer.option("parquet.block.row.count.limit", group).option("parquet.page.row.count.limit", min(group, 20_000))
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", True).option(f"parquet.bloom.filter.expected.ndv#{c}", group).option(f"parquet.bloom.filter.fpp#{c}", wrong)
        writer = writer.option(f"parquet.enable.dictionary#{c}", False)  # a filter isn't kept where a dictionary holds all values
    writer.parquet(path)


def any_of(column: str, keys: list) -> Column:
    """column is one of these keys, as comparisons that row groups are tested by (a long list would become its bounds)."""
    found = F.lit(False)
    for k in keys:
        found = found | (F.col(column) == F.lit(k))
    return found


def found(spark: SparkSession, path: str, column: str, keys: list, columns: list[str] | None = None) -> DataFrame:
    """The rows whose column is one of at most PUSHED keys."""
    if len(keys) > PUSHED:
        raise ValueError(f"more than {PUSHED} keys: use joined()")
    rows = spark.read.parquet(path)
    known = [k for k in dict.fromkeys(keys) if k is not None]
    if not known:
        return rows.limit(0).select(*(columns or rows.columns))
    return rows.where(any_of(column, known)).select(*(columns or rows.columns))


def joined(spark: SparkSession, path: str, column: str, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows whose column is among keys (one column, of any number of rows)."""
    rows = spark.read.parquet(path).select(*(columns or spark.read.parquet(path).columns))
    wanted = keys.select(F.col(keys.columns[0]).alias("__key")).where("__key is not null").distinct()
    return rows.join(wanted, F.col(column) == F.col("__key"), "left_semi")
