"""JSON maps, manifests, lanes, and data behind charts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumigrid.functions import vectors as V
from lumigrid.plans import weights as W
from lumigrid.plans.corpus import corpus, memberships, table
from lumigrid.queries.base import CORPUS, MEMBERS, query, r6
from lumigrid.sources import changelog, lookup, shared
from lumigrid.sources import json_maps as J
from lumigrid.sources import tables as T


@query("json_ground_truth", "SELECT cluster_key, pos, file_name FROM members", MEMBERS)
def json_ground_truth(spark, sf_dir):
    lists = J.to_map(memberships(spark, sf_dir))
    whole = lists.select(F.to_json(F.create_map("cluster_key", "files")).alias("value"))
    return J.clusters(J.exploded(whole, "value", J.GROUND_TRUTH))


@query("json_weights", "SELECT k AS feature, w AS weight FROM (VALUES ('hog', 0.5::DOUBLE), ('lbp', 0.25)) t(k, w)")
def json_weights(spark, sf_dir):
    texts = spark.createDataFrame([('{"hog": 0.5, "lbp": 0.25}',), ("{broken",), ("",)], "value string")
    return J.exploded(texts, "value", J.WEIGHTS).select(F.col("key").alias("feature"), F.col("value").alias("weight"))


@query("json_cache", "SELECT 'img_' || vec_id AS key, 'c' || label AS category, 1::BIGINT AS n FROM embeddings")
def json_cache(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    value = F.struct(F.concat(F.lit("c"), "label").alias("category"), F.lit("d").alias("description"), F.array(F.lit("e")).alias("entities"))
    texts = e.select(F.to_json(F.create_map(F.concat(F.lit("img_"), "vec_id"), value)).alias("value"))
    return J.exploded(texts, "value", J.CACHE).select("key", F.col("value.category").alias("category"), F.size("value.entities").cast("long").alias("n"))


@query("group_to_list", "SELECT cluster_key, list(file_name ORDER BY pos) AS files, count(*)::BIGINT AS n FROM members GROUP BY cluster_key", MEMBERS)
def group_to_list(spark, sf_dir):
    return J.to_map(memberships(spark, sf_dir)).withColumn("n", F.size("files").cast("long"))


@query("cluster_manifest", "SELECT 'cluster_' || lpad(label::VARCHAR, 2, '0') AS cluster_id, file_name AS src, 'out/cluster_' || lpad(label::VARCHAR, 2, '0') || '/' || list_extract(string_split(file_name, '/'), -1) AS dst FROM corpus", CORPUS)
def cluster_manifest(spark, sf_dir):
    chosen = J.to_map(memberships(spark, sf_dir)).select(F.col("cluster_key").alias("ordinal"), F.col("files").alias("images"))
    return T.cluster_manifest(chosen, "out")


@query("json_rows", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS value FROM documents")
def json_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("value"))


@query("chart_scores", f"SELECT label, {r6('avg(sharpness)')} AS mean, {r6('min(sharpness)')} AS low, {r6('max(sharpness)')} AS high, count(*)::BIGINT AS n FROM corpus GROUP BY label", CORPUS)
def chart_scores(spark, sf_dir):
    g = corpus(spark, sf_dir).groupBy("label").agg(F.avg("sharpness").alias("mean"), F.min("sharpness").alias("low"), F.max("sharpness").alias("high"), F.count(F.lit(1)).alias("n"))
    return g.select("label", *[V.rounded(F.col(c)).alias(c) for c in ("mean", "low", "high")], "n")


@query("lanes", "SELECT * FROM (VALUES ('equal', 'dreamsim,text,traditional,vlm'), ('hog only', 'traditional'), ('category and negative hog', 'vlm'), ('semantic', 'text,vlm'), ('saliency, compat', '')) t(case_, lanes)")
def lanes(spark, sf_dir):
    cases = [("equal", W.lanes("equal", None)), ("hog only", W.lanes("manual", {"hog": 1.0})), ("category and negative hog", W.lanes("manual", {"category": 1.0, "hog": -1.0})), ("semantic", W.lanes("manual", {"semantic": 0.5})), ("saliency, compat", W.lanes("manual", {"saliency": 1.0}, compat=True))]
    return spark.createDataFrame([(k, ",".join(sorted(v))) for k, v in cases], "case_ string, lanes string")


def _place(spark, name):
    return f"{shared.folder(spark)}/lumigrid/{name}-{uuid.uuid4().hex}"


@query("lookup_by_hash", "SELECT id, file_name, file_hash FROM corpus WHERE file_hash IN (SELECT file_hash FROM corpus WHERE id % 100 = 0)", CORPUS)
def lookup_by_hash(spark, sf_dir):
    """The hashes of every hundredth row, in a table that is clustered by id and has Bloom filters for hashes."""
    c, path = corpus(spark, sf_dir), _place(spark, "clustered")
    lookup.clustered(c, path, "id", ("file_hash",))
    return lookup.joined(spark, path, "file_hash", c.where("id % 100 = 0").select("file_hash"), ["id", "file_name", "file_hash"])


@query("cache_log", """SELECT file_name AS key, unnest(CASE WHEN id % 10 = 0 THEN ['description'] WHEN id % 3 = 0 THEN ['category', 'description'] ELSE ['category'] END) AS field,
  unnest(CASE WHEN id % 10 = 0 THEN ['again'] WHEN id % 3 = 0 THEN ['Changed', 'd' || label] ELSE ['c' || label] END) AS value
  FROM corpus WHERE id % 5 <> 0 OR id % 10 = 0""", CORPUS)
def cache_log(spark, sf_dir):
    """A log of four changes: fields of all rows, other fields of every third, every fifth deleted, every tenth put back.
    A row's key is its name and id, since names are cut to five digits and repeat from 100,000 rows on."""
    rows, log = corpus(spark, sf_dir).withColumn("key", F.concat("file_name", F.lit("#"), "id")), changelog.ChangeLog(spark, _place(spark, "cache"))
    change = lambda df, **fields: df.select("key", F.lit(0).alias("seq"), F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)]).alias("value"))
    log.put(change(rows, category=F.concat(F.lit("c"), "label")))
    log.put(change(rows.where("id % 3 = 0"), category=F.lit("Changed"), description=F.concat(F.lit("d"), "label")))
    log.delete(rows.where("id % 5 = 0"))
    log.put(change(rows.where("id % 10 = 0"), description=F.lit("again")))
    return log.read().select(F.regexp_replace("key", r"#-?\d+$", "").alias("key"), F.explode("value").alias("field", "value"))
