"""Writing tables and blobs: appends, new versions, exports as manifests, and reads over JDBC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.functions import names


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def new_version(df: DataFrame, path: str) -> None:
    """Writes a whole new version; path must not be one that df reads."""
    df.write.mode("overwrite").parquet(path)


def recreate(spark: SparkSession, schema, path: str) -> None:
    """An empty table of the schema: everything at path is replaced, so callers must mean it."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def blobs(files: DataFrame, folder: str) -> DataFrame:
    """Writes (relative, content) below a folder of the shared file system; gives (relative, bytes, error). Names stay
    inside the folder; a failing file has its error and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            out = []
            for relative, content in b[["relative", "content"]].itertuples(index=False):
                error = None
                try:
                    parts = [p for p in relative.split("/") if p not in ("", ".")]
                    if ".." in parts or not parts:
                        raise ValueError("a name that leaves the folder")
                    store.create_dir("/".join([root, *parts[:-1]]), recursive=True)
                    with store.open_output_stream("/".join([root, *parts])) as f:
                        f.write(bytes(content))
                except (OSError, ValueError) as e:
                    error = str(e)
                out.append((relative, len(content), error))
            yield pd.DataFrame(out, columns=["relative", "bytes", "error"])

    return files.select("relative", "content").mapInPandas(run, "relative string, bytes long, error string")


def cluster_manifest(chosen: DataFrame, target: str) -> DataFrame:
    """(cluster_id, src, dst) of the copies that would lay each chosen cluster (ordinal, images) into a folder of its own."""
    each = chosen.select("ordinal", F.explode("images").alias("src"))
    label = names.cluster_label(F.col("ordinal"))
    return each.select(label.alias("cluster_id"), "src", F.concat_ws("/", F.lit(target), label, names.basename(F.col("src"))).alias("dst"))


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 20, **options) -> DataFrame:
    """A table over JDBC, in `partitions` ranges of a numeric column if one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
