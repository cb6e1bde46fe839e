"""The folder that the driver and all executors share, for tables between two steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where driver and executors are one process and the session names no folder (tests, a laptop).
LOCAL = "/tmp/checkpoints/lumigrid"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it, a folder of this machine if all of Spark is on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL


def by_number(df: DataFrame, number: str, name: str) -> tuple[str, list[int]]:
    """Writes df with a folder for each value of the column `number`; gives the path and the values, for read_number() in tasks."""
    path = f"{folder(df.sparkSession)}/lumigrid/{name}-{uuid.uuid4().hex}"
    df.withColumn("part", F.col(number)).write.partitionBy("part").parquet(path)
    kept = df.sparkSession.read.schema(f"{number} long, part long").parquet(path)
    return path, sorted(r["part"] for r in kept.select("part").distinct().collect())


def read_number(path: str, number: int, column: str) -> Iterator[object]:
    """The column's values in the folder of a number, read by a task; a folder that isn't there is an error."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    for file in store.get_file_info(fs.FileSelector(f"{root}/part={number}")):
        if file.base_name.endswith(".parquet"):
            with store.open_input_file(file.path) as opened:
                yield from (x.as_py() for x in pq.ParquetFile(opened).read([column]).column(column))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows doesn't work it out again, and a lost executor costs its tasks."""
    path = f"{folder(df.sparkSession)}/lumigrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
