"""Derived relations over the test tables: an image corpus, ground truth memberships, and pixels; in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_CORPUS = """
SELECT vec_id + 1 AS id,
  concat('cluster_', label, '/img_', lpad(CAST(vec_id AS STRING), 5, '0'), '.jpg') AS file_name,
  CASE WHEN vec_id % 50 <> 7 THEN CAST(abs(embedding[0]) AS DOUBLE) END AS brightness,
  100.0D * CAST(abs(embedding[4]) AS DOUBLE) AS sharpness,
  CASE WHEN vec_id % 89 = 5 THEN array_repeat(CAST(0 AS FLOAT), 16) WHEN vec_id % 97 <> 13 THEN slice(embedding, 1, 16) END AS hog_vector,
  CASE WHEN vec_id % 97 <> 13 THEN transform(slice(embedding, 33, 19), x -> CAST(x * 255 AS FLOAT)) END AS meta_moments_mean,
  CASE WHEN vec_id % 97 <> 13 THEN embedding END AS dreamsim_vector,
  CASE CAST(vec_id % 6 AS INT) WHEN 0 THEN 'Nature' WHEN 1 THEN 'nature' WHEN 2 THEN 'General' WHEN 3 THEN 'Vehicle' WHEN 4 THEN '' END AS category,
  CASE WHEN vec_id % 61 = 3 THEN NULL WHEN vec_id % 61 = 4 THEN CAST(array() AS ARRAY<STRING>)
       ELSE transform(array(vec_id % 5, (vec_id * 3 + 1) % 7, CAST(label % 5 AS BIGINT)), k -> concat('Ent', k)) END AS entities,
  CASE WHEN vec_id % 10 <> 9 THEN md5(CAST(vec_id AS STRING)) END AS file_hash,
  timestampadd(MINUTE, CAST(vec_id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS created_at,
  label
FROM {embeddings}
"""

SQL_CORPUS = """corpus AS (
SELECT vec_id + 1 AS id,
  concat('cluster_', label, '/img_', lpad(vec_id::VARCHAR, 5, '0'), '.jpg') AS file_name,
  CASE WHEN vec_id % 50 <> 7 THEN abs(embedding[1])::DOUBLE END AS brightness,
  100.0::DOUBLE * abs(embedding[5])::DOUBLE AS sharpness,
  CASE WHEN vec_id % 89 = 5 THEN list_transform(range(16), lambda i: 0::FLOAT) WHEN vec_id % 97 <> 13 THEN embedding[1:16] END AS hog_vector,
  CASE WHEN vec_id % 97 <> 13 THEN list_transform(embedding[33:51], lambda x: (x * 255)::FLOAT) END AS meta_moments_mean,
  CASE WHEN vec_id % 97 <> 13 THEN embedding END AS dreamsim_vector,
  CASE vec_id % 6 WHEN 0 THEN 'Nature' WHEN 1 THEN 'nature' WHEN 2 THEN 'General' WHEN 3 THEN 'Vehicle' WHEN 4 THEN '' END AS category,
  CASE WHEN vec_id % 61 = 3 THEN NULL WHEN vec_id % 61 = 4 THEN []::VARCHAR[]
       ELSE list_transform([vec_id % 5, (vec_id * 3 + 1) % 7, (label % 5)::BIGINT], lambda k: concat('Ent', k)) END AS entities,
  CASE WHEN vec_id % 10 <> 9 THEN md5(vec_id::VARCHAR) END AS file_hash,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS created_at,
  label
FROM embeddings)"""

PIXELS = """SELECT i.id AS img_id, y.id AS y, x.id AS x,
  (i.id * 31 + y.id * 17 + x.id * 13) % 256 AS b, (i.id * 7 + y.id * y.id * 3 + x.id * 5) % 256 AS g, (i.id * 11 + x.id * y.id * 2 + 40) % 256 AS r
FROM {n20} i CROSS JOIN {n16} y CROSS JOIN {n16} x"""
SQL_PIXELS = "pixels AS (" + PIXELS.format(n20="(SELECT range AS id FROM range(20))", n16="(SELECT range AS id FROM range(16))") + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_CORPUS, embeddings=table(spark, sf_dir, "embeddings"))


def pixels(spark: SparkSession) -> DataFrame:
    return spark.sql(PIXELS.format(n20="range(20)", n16="range(16)"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_key, pos, file_name): corpus members by label, in id order."""
    from pyspark.sql.window import Window

    df = corpus(spark, sf_dir)
    return df.select(F.col("label").cast("string").alias("cluster_key"), (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).cast("long").alias("pos"), "file_name")


SQL_MEMBERS = "members AS (SELECT label::VARCHAR AS cluster_key, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos, file_name FROM corpus)"
