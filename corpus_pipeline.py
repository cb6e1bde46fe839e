"""From raw documents to packed sequences: five stages, each written as Parquet in the shared folder and read again.

toxicity drops documents that the classifier rejects; near_duplicates keeps one document of each group; secrets masks
credentials in the texts; mixture drops and repeats documents by their source's target; packing lays what remains into
sequences, a row for each piece.

Defined results: null and empty texts have the classifier's prior, are no near duplicates of anything, hold no secrets and
are dropped by the mixture, which takes words; of rows that repeat an id and a text one stays, of an id with unlike texts
one row a group of near duplicates; rows with a null id stay; ties go to the lower id; very long texts are read whole;
columns beyond those of documents pass through; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumigrid.llm import common, jaccard, mixing, packing, secret_scan, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.kept(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mixture", mixture),
    ("packing", pack),
]

#: The classifier, the components of the link graph and the packing have no SQL. tests/llm compare each stage's operator with
#: brute force or plain Python, two stages on their own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
