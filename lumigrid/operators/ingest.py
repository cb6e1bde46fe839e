"""Ingest: path lists, duplicates, and what a scan of files needs done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumigrid.functions import names, vectors


def path_clusters(paths: DataFrame) -> DataFrame:
    """(cluster_key, pos, file_name) from rows (ord, paths: a JSON list of strings): the folder is the cluster; a file
    counts where it is seen first in its folder; malformed JSON and paths of one part are left out."""
    each = paths.select("ord", F.posexplode(F.from_json("paths", "array<string>")).alias("i", "path"))
    parts = each.select("ord", "i", names.folder_and_file(F.col("path")).alias("p")).where("p is not null")
    first = parts.groupBy(F.col("p.folder").alias("cluster_key"), F.col("p.file").alias("file_name")).agg(F.min(F.struct("ord", "i")).alias("at"))
    w = Window.partitionBy("cluster_key").orderBy("at")
    return first.select("cluster_key", (F.row_number().over(w) - 1).cast("long").alias("pos"), "file_name")


def folder_clusters(paths: DataFrame) -> DataFrame:
    """(cluster, label, n, files) from file paths (path): sub-folders numbered from 1 by name, images only."""
    files = paths.where(names.is_image(F.col("path"), names.IMPORTED)).select(names.folder_and_file(F.col("path")).alias("p")).where("p is not null")
    by = files.groupBy(F.col("p.folder").alias("label")).agg(F.array_sort(F.collect_list("p.file")).alias("files"))
    # one row a folder: the numbering window holds folder names only
    return by.select(F.row_number().over(Window.orderBy("label")).cast("long").alias("cluster"), "label", F.size("files").cast("long").alias("n"), "files")


def classified(scanned: DataFrame, stored: DataFrame, vector: str) -> DataFrame:
    """scanned (file_name, file_hash) with action: SKIP (hash stored, vector valid), FIX (hash stored, vector not),
    UPDATE_HASH (name stored), PROCESS (neither); and the stored id."""
    by_hash = stored.where("file_hash is not null").groupBy(F.col("file_hash").alias("__hash")).agg(F.max_by(F.struct("id", vectors.valid(F.col(vector)).alias("ok")), "id").alias("h"))
    by_name = stored.groupBy(F.col("file_name").alias("__name")).agg(F.max("id").alias("name_id"))
    joined = scanned.join(by_hash, F.col("file_hash") == F.col("__hash"), "left").join(by_name, F.col("file_name") == F.col("__name"), "left")
    action = F.when(F.col("h").isNotNull(), F.when(F.col("h.ok"), "SKIP").otherwise("FIX")).when(F.col("name_id").isNotNull(), "UPDATE_HASH").otherwise("PROCESS")
    return joined.select("file_name", "file_hash", action.alias("action"), F.coalesce("h.id", "name_id").alias("id"))


def in_batches(df: DataFrame, size: int = 32) -> DataFrame:
    """Numbers rows into batches of `size` by id, each partition on its own: no shuffle, and no batch crosses tasks."""
    n = F.row_number().over(Window.partitionBy("__p").orderBy("id")) - 1
    return df.withColumn("__p", F.spark_partition_id()).withColumn("batch", F.concat_ws("-", "__p", F.floor(n / size))).drop("__p")


def first_of_duplicates(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def next_ids(new: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """New rows with ids after the stored ones, without sorting all rows in one task: rows are ranked within cells of
    their order's hash, behind the counts of the cells before."""
    cells = 256
    dealt = new.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = dealt.groupBy("__cell").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__max"))
    base = counts.select(F.col("__cell").alias("__c"), before.alias("__before")).join(F.broadcast(start), F.lit(True))
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy(*order))
    return dealt.withColumn("__r", rank).join(base, F.col("__cell") == F.col("__c")).withColumn("id", (F.col("__max") + F.col("__before") + F.col("__r")).cast("long")).drop("__cell", "__c", "__r", "__before", "__max")
