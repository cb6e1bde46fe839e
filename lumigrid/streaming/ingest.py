"""Ingest as a file stream: rows whose key has not been seen are added to a table of snapshots, each once.

Which keys have been seen is keyed state: a micro-batch looks up its own keys in the state store and reads no stored row,
however large the table is. A new stream over a table that has rows already begins with their keys, which are written
once and come in its first micro-batch. A micro-batch is one commit of the table under its number, so one that runs again
after a failure adds nothing twice.

With many keys use spark.sql.streaming.stateStore.providerClass of RocksDB, which keeps state on disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumigrid.sources import snapshots

SEED, KEY = "__stored", "__key"


def source(spark: SparkSession, folder: str, schema, files_per_batch: int = 32) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _once(df: DataFrame, path: str) -> str:
    """path, after df has been written there, if it hasn't been yet."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(path)
    return path


def unseen(stream: DataFrame, seeds: DataFrame) -> DataFrame:
    """The first row by file name of each key (KEY) that neither an earlier micro-batch nor a seed has had."""
    both = stream.withColumn(SEED, F.lit(False)).unionByName(seeds.withColumn(SEED, F.lit(True)), allowMissingColumns=True)
    columns = [f for f in both.schema.fields if f.name not in (SEED, KEY)]

    def first(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:  # nothing more can come of this key; its rows are not even looked at
            for _part in parts:
                pass
            return
        rows = pd.concat(list(parts))
        state.update((True,))
        if not rows[SEED].any():
            yield rows.sort_values("file_name", kind="stable").iloc[:1][[f.name for f in columns]]

    return both.groupBy(KEY).applyInPandasWithState(first, T.StructType(columns), T.StructType([T.StructField("seen", T.BooleanType())]), "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds new rows (file_name, file_hash, ...) to a table of snapshots, which is made if there is none. A row's key is its
    hash, or its name if it has none. Rows whose name is stored without a hash are not new; these names are noted when the
    stream begins. Of equal keys the first file name of the first micro-batch stays."""
    spark = stream.sparkSession
    kept = snapshots.Snapshots(spark, table)
    if not kept.versions():
        kept.create(stream.schema)
    name = hashlib.md5(checkpoint.encode()).hexdigest()
    stored = kept.read()
    key = F.coalesce("file_hash", "file_name")
    seeds = _once(stored.select(key.alias(KEY)).distinct(), f"{kept.path}/streams/{name}/keys")
    unhashed = spark.read.schema("name string").parquet(_once(stored.where("file_hash is null").select(F.col("file_name").alias("name")).distinct(), f"{kept.path}/streams/{name}/unhashed"))
    new = stream.join(unhashed, F.col("file_name") == F.col("name"), "left_anti").withColumn(KEY, key)
    fresh = unseen(new, spark.readStream.schema(f"{KEY} string").parquet(seeds))

    def each(batch: DataFrame, number: int) -> None:
        kept.append(batch.withColumn("file_hash", F.coalesce("file_hash", "file_name")), (checkpoint, number))

    writer = fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
