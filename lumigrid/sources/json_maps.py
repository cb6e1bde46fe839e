"""JSON maps (ground truth, weights, cache, evaluations) as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUND_TRUTH = "map<string,array<string>>"
WEIGHTS = "map<string,double>"
CACHE = "map<string,struct<category:string,description:string,entities:array<string>>>"


def exploded(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """(key, value) of JSON maps held whole in a text column; malformed and empty texts give no rows."""
    return texts.select(F.explode(F.from_json(F.col(column), schema)).alias("key", "value"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return exploded(spark.read.text(path, wholetext=True), "value", schema)


def clusters(maps: DataFrame) -> DataFrame:
    """(cluster_key, pos, file_name) of a ground-truth map."""
    return maps.select(F.col("key").alias("cluster_key"), F.posexplode("value").alias("pos", "file_name")).select("cluster_key", F.col("pos").cast("long").alias("pos"), "file_name")


def weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Stored weights; {} if the file can't be read. At most a number for each of 31 features."""
    try:
        return {r["key"]: r["value"] for r in read(spark, path, WEIGHTS).where("value is not null").collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def to_map(members: DataFrame) -> DataFrame:
    """One row a cluster (cluster_key, files), files in their order."""
    return members.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file_name"))), lambda x: x["file_name"]).alias("files"))


def parsed(column: Column, schema: str) -> Column:
    """A JSON text as its schema, null where it is malformed."""
    return F.from_json(column, schema)


def write(df: DataFrame, path: str, as_map: tuple[str, str] | None = None) -> None:
    """Rows as JSON lines; as_map (key, value): one {key: value} object a line, so readers can merge the lines."""
    out = df.select(F.to_json(F.create_map(*[F.col(c) for c in as_map])).alias("value")) if as_map else df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    out.write.mode("overwrite").text(path)
