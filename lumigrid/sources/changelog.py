"""A cache of fields as a log of changes: writers append what changes, readers merge, compaction shortens the log.

A change sets one field of one key; a deletion ends all fields that came before it. Each append is a commit of a table of
snapshots, so two writers lose nothing of each other's and the order of commits decides: what is committed later wins,
within a commit the greater seq, of equal ones the greater value. A damaged file is skipped with what it holds; the rest
of the log still answers.

Defined results: null keys are no rows of the cache; a null value is a field whose value is null; an empty change is no
commit; repeated changes count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.sources.snapshots import Snapshots

#: kind: "set" or "delete" (then field and value are null).
SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "seq" else T.StringType()) for n in ("key", "seq", "kind", "field", "value")])


class ChangeLog:
    """The cache at `path`, made if there is none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Snapshots(spark, path)
        if not self.table.versions():
            try:
                self.table.create(SCHEMA)
            except Exception:
                if not self.table.versions():  # not just another writer that was first
                    raise

    def put(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Merges changes (key, seq, value map<string, string>) into the cache: a key keeps fields that they don't name.
        batch (stream, number): a number that has been committed is not committed again."""
        each = changes.where("key is not null").select("key", F.col("seq").cast("long").alias("seq"), F.lit("set").alias("kind"), F.explode("value").alias("field", "value"))
        return self._append(each, batch)

    def delete(self, keys: DataFrame) -> int:
        """Removes keys (key)."""
        gone = keys.where("key is not null").select("key").distinct()
        return self._append(gone.select("key", F.lit(0).cast("long").alias("seq"), F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))

    def _append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        return self.table.append(rows, batch)

    def _placed(self, version: int | None = None) -> DataFrame:
        """The log with each row's place: the number of its folder in the order of commits."""
        head = self.table.manifest(version)
        if not head.folders:
            return self.spark.createDataFrame([], SCHEMA).withColumn("place", F.lit(0))
        rows = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", True).parquet(*[f"{self.table.path}/{f}" for f in head.folders])
        # a number for each folder since the last compaction
        places = F.create_map(*[F.lit(x) for i, f in enumerate(head.folders) for x in (f.rsplit("/", 1)[-1], i)])
        return rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder")).withColumn("place", F.element_at(places, F.col("folder"))).drop("folder")

    def _last(self, version: int | None = None) -> DataFrame:
        """(key, field, seq, value) of the fields that hold."""
        # both ends are aggregates of the same keys, so map-side sums keep a hot key small and nothing is collected for a key
        log = self._placed(version)
        order = F.struct("place", "seq", "value")
        fields = log.where("kind = 'set'").groupBy("key", "field").agg(F.max(F.struct(order.alias("o"), F.col("value").alias("v"))).alias("m"))
        gone = log.where("kind = 'delete'").groupBy("key").agg(F.max("place").alias("gone"))
        kept = fields.join(gone, "key", "left").where("gone is null or m.o.place > gone")
        return kept.select("key", "field", F.col("m.o.seq").alias("seq"), F.col("m.v").alias("value"))

    def read(self, version: int | None = None) -> DataFrame:
        """(key, value map) of the newest version, or of one that is named."""
        return self._last(version).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("value"))

    def get(self, *keys: str) -> DataFrame:
        """(key, value) of these keys alone."""
        return self.read().where(F.col("key").isin(*keys))

    def compact(self) -> int:
        """One folder with the fields that hold, instead of all changes. Changes that are committed meanwhile make it start
        again, so none is lost. Damaged files are left behind."""
        return self.table.update(lambda _: self._last().select("key", "seq", F.lit("set").alias("kind"), "field", "value"))
