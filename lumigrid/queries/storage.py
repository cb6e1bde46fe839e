"""Files, commits, requests to models and kept results over the given tables.

Each row of the embeddings is a small picture of its first 48 components, which is written to the shared folder as a bitmap
file: what a source reads, a decoder decodes or an export copies here has been written from the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumigrid.functions import vectors as V
from lumigrid.operators import flows
from lumigrid.operators import groundtruth as G
from lumigrid.plans.corpus import corpus, memberships, table
from lumigrid.queries.base import CORPUS, MEMBERS, query, r6
from lumigrid.queries.io import _place
from lumigrid.sources import images, shared, snapshots
from lumigrid.sources import tables as T

#: A bitmap's header: 102 bytes in all, 4 x 4 pixels of 24 bits, the lowest line first.
HEADER = "424D66000000000000003600000028000000040000000400000001001800000000003000000000000000000000000000000000000000"
LINE, LINES = 12, 4
_ORDER = [range(LINE * y, LINE * (y + 1)) for y in reversed(range(LINES))]

_SQL_FILES = f"""files AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'cluster_' || coalesce(label::VARCHAR, 'none') || '/' END || 'img_' || vec_id || ['.jpg', '.PNG', '.jpeg', '.txt', '.bmp'][vec_id % 5 + 1] AS relative,
  array_to_string(list_transform(embedding[1:{LINE * LINES}], lambda x: printf('%02X', floor(abs(x::DOUBLE) * 255)::BIGINT % 256)), '') AS seen,
  unhex('{HEADER}' || {" || ".join(f"seen[{2 * r[0] + 1}:{2 * r[-1] + 2}]" for r in _ORDER)}) AS content
  FROM embeddings)"""
FILES = (_SQL_FILES,)


def _pictures(spark, sf_dir):
    """(id, label, relative, content, seen): a bitmap, and its pixels as hexadecimal digits from the highest line down."""
    byte = lambda i: F.lpad(F.hex(F.floor(F.abs(F.col("embedding")[i].cast("double")) * 255).cast("long") % 256), 2, "0")
    said = lambda places: F.concat(*[byte(i) for i in places])
    folder = F.when(F.col("vec_id") % 3 == 0, "").otherwise(F.concat(F.lit("cluster_"), F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lit("/")))
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".jpeg", ".txt", ".bmp"))), (F.col("vec_id") % 5).cast("int") + 1)
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.concat(folder, F.lit("img_"), F.col("vec_id").cast("string"), suffix).alias("relative"), F.unhex(F.concat(F.lit(HEADER), *map(said, _ORDER))).alias("content"), said(range(LINE * LINES)).alias("seen"))


def _stored(pictures, folder):
    """Writes the pictures' files below a folder; the outcome of each is a written table."""
    return shared.written(T.blobs(pictures, folder), "blobs")


@query("blob_writes", "SELECT CASE WHEN id % 11 = 0 THEN '../' ELSE '' END || relative AS relative, octet_length(content)::BIGINT AS bytes, CASE WHEN id % 11 = 0 THEN 'a name that leaves the folder' END AS error FROM files", FILES)
def blob_writes(spark, sf_dir):
    """What becomes of each file's write: every eleventh has a name outside the folder, which is refused while the others go on."""
    names = F.concat(F.when(F.col("id") % 11 == 0, "../").otherwise(""), "relative")
    return _stored(_pictures(spark, sf_dir).withColumn("relative", names), _place(spark, "pictures"))


@query("image_files", """SELECT recursive, relative, string_split(relative, '/')[-1] AS file_name, octet_length(content)::BIGINT AS length, md5(content) AS file_hash FROM files, (VALUES (false), (true)) t(recursive)
  WHERE id % 5 < 3 AND (recursive OR NOT contains(relative, '/'))""", FILES)
def image_files(spark, sf_dir):
    """Image files by suffix, of a folder alone and with all folders below it."""
    place = _place(spark, "pictures")
    _stored(_pictures(spark, sf_dir), place)
    flat, deep = (images.files(spark, place, recursive).select(F.lit(recursive).alias("recursive"), "relative", "file_name", "length", F.md5("content").alias("file_hash")) for recursive in (False, True))
    return flat.unionByName(deep)


@query("image_decoded", "SELECT id, 4 AS height, 4 AS width, 3 AS channels, seen FROM files WHERE id % 7 <> 3", FILES)
def image_decoded(spark, sf_dir):
    """The pixels of files that decode, blue, green and red; every seventh file is cut off and left out."""
    place, pictures = _place(spark, "pictures"), _pictures(spark, sf_dir)
    content = F.when(F.col("id") % 7 == 3, F.substring("content", 1, 9)).otherwise(F.col("content"))
    _stored(pictures.select(F.concat(F.lit("img_"), F.col("id").cast("string"), F.lit(".bmp")).alias("relative"), content.alias("content")), place)
    return images.decoded(spark, place).select(F.regexp_extract("origin", r"img_(\d+)\.bmp$", 1).cast("long").alias("id"), "height", "width", "channels", F.hex("data").alias("seen"))


@query("cluster_copies", "SELECT 'cluster_' || lpad(label::VARCHAR, 2, '0') AS cluster_id, string_split(relative, '/')[-1] AS name, CASE WHEN id % 13 <> 0 THEN octet_length(content) END::BIGINT AS bytes, CASE WHEN id % 13 <> 0 THEN sha256(content) END AS sha256, id % 13 = 0 AS failed FROM files", FILES)
def cluster_copies(spark, sf_dir):
    """Copies of all clusters' files, hashed as they are read back; every thirteenth file isn't there and has an error."""
    source, target, pictures = _place(spark, "pictures"), _place(spark, "copies"), _pictures(spark, sf_dir)
    _stored(pictures.where("id % 13 <> 0"), source)
    each = pictures.select(F.col("label").cast("string").alias("ordinal"), F.array("relative").alias("images"))
    out = flows.exported_clusters(each, source, target)
    return out.select("cluster_id", F.element_at(F.split("src", "/"), -1).alias("name"), "bytes", "sha256", F.col("error").isNotNull().alias("failed"))


@query("table_commits", """SELECT id, file_name, CASE WHEN error IS NULL AND id % 4 = 0 THEN upper(category) ELSE category END AS category, coalesce(error, 'stored') AS state
  FROM (SELECT *, nullif(concat_ws('; ', CASE WHEN file_hash IS NULL THEN 'no hash' END, CASE WHEN coalesce(category, '') = '' THEN 'no category' END), '') AS error FROM corpus)""", CORPUS)
def table_commits(spark, sf_dir):
    """A table of snapshots after an insert that refuses rows, an update, an append, and a rollback of the append; the refused
    rows have their errors."""
    rows = corpus(spark, sf_dir).select("id", "file_name", "file_hash", "category")
    t = snapshots.Snapshots(spark, _place(spark, "table"))
    t.create(rows.schema)
    refused = t.insert(rows, {"no hash": F.col("file_hash").isNotNull(), "no category": F.coalesce("category", F.lit("")) != ""})
    kept = t.update(lambda df: df.withColumn("category", F.when(F.col("id") % 4 == 0, F.upper("category")).otherwise(F.col("category"))))
    t.append(rows)
    t.rollback(kept)
    return t.read().withColumn("state", F.lit("stored")).unionByName(refused.withColumnRenamed("error", "state")).drop("file_hash")


def _numbered(rows):
    """rows with their numbers in their file names: these are cut to five digits and repeat from 100,000 rows on."""
    return rows.withColumn("file_name", F.concat("file_name", F.lit("#"), F.col("id") - 1))


def _number(name: str) -> int:
    return int(re.search(r"#(-?\d+)$", name)[1])


def analyse(files: list[str]) -> list[dict]:
    """Stands for a model: what it says follows from the file's number, and every seventeenth fails."""
    numbers = [_number(f) for f in files]
    if any(n % 17 == 5 for n in numbers):
        raise ValueError("no answer")
    return [{"category": f"C{n % 4}", "description": f"Picture {n}", "entities": [f"E{n % 3}", f"E{n % 5}"]} for n in numbers]


def embed(texts: list[str]) -> list[list[float]]:
    """Stands for a model of texts: how long they are, how many ones they hold, and 1."""
    return [[len(t), t.count("1"), 1] for t in texts]


_SAID = """said AS (SELECT *, id - 1 AS n, (id - 1) % 17 <> 5 AS ok, 'Category: C' || (id - 1) % 4 || '. Entities: E' || (id - 1) % 3 || ', E' || (id - 1) % 5 || '. Description: Picture ' || (id - 1) AS t FROM corpus),
  asked AS (SELECT *, CASE WHEN ok THEN 'C' || n % 4 ELSE 'Error' END AS new_category, CASE WHEN ok THEN 'Picture ' || n ELSE 'Error' END AS new_description, CASE WHEN ok THEN 'E' || n % 3 || ',E' || n % 5 ELSE '' END AS new_entities,
    CASE WHEN ok THEN list_transform([length(t), length(t) - length(replace(t, '1', '')), 1], lambda x: round((x / sqrt((length(t) ** 2 + (length(t) - length(replace(t, '1', ''))) ** 2 + 1)::DOUBLE))::FLOAT::DOUBLE, 6)) END AS new_vector FROM said)"""


def _shown(df, *keys):
    return df.select(*keys, "category", "description", F.array_join("entities", ",").alias("entities"), F.transform("llm_embedding", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


@query("semantics_asked", "SELECT file_name, new_category AS category, new_description AS description, new_entities AS entities, new_vector AS vector FROM asked", (*CORPUS, _SAID))
def semantics_asked(spark, sf_dir):
    """What a model says of each file, requests that fail being asked file by file, and the embedding of what it said."""
    said = flows.semantics(_numbered(corpus(spark, sf_dir)).select("file_name"), analyse, embed)
    return _shown(said.withColumn("file_name", F.regexp_replace("file_name", r"#-?\d+$", "")), "file_name")


_MISSES = "(coalesce(category, '') = '' OR id % 4 = 0 OR id % 3 = 0) AND id % 5 <> 0"


@query("semantics_completed", f"""SELECT id, CASE WHEN {_MISSES} THEN new_category ELSE category END AS category, CASE WHEN {_MISSES} THEN new_description WHEN id % 3 <> 0 THEN 'old' END AS description,
  CASE WHEN {_MISSES} THEN new_entities ELSE array_to_string(entities, ',') END AS entities, CASE WHEN {_MISSES} THEN new_vector WHEN id % 4 <> 0 THEN [1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] END AS vector FROM asked""", (*CORPUS, _SAID))
def semantics_completed(spark, sf_dir):
    """The table after semantics were made anew for rows that miss any and whose file is there: every fifth file isn't."""
    rows = _numbered(corpus(spark, sf_dir))
    vector = F.when(F.col("id") % 4 != 0, F.array(*[F.lit(x).cast("float") for x in (1, 0, 0)]))
    rows = rows.select("id", "file_name", "category", F.when(F.col("id") % 3 != 0, "old").alias("description"), "entities", vector.alias("llm_embedding"))
    return _shown(flows.completed(rows, rows.where("id % 5 <> 0").select("file_name"), analyse, embed), "id")


@query("stats_cached", f"SELECT cluster_key, count(*)::BIGINT AS n, {r6('avg(pos)')} AS mean FROM members GROUP BY cluster_key", MEMBERS)
def stats_cached(spark, sf_dir):
    """Statistics that the second caller gets from the cache, as the ground truth hasn't changed since: it would fail otherwise."""
    truth, cache = _place(spark, "truth"), _place(spark, "statistics")
    T.new_version(memberships(spark, sf_dir), truth)
    made = lambda: spark.read.parquet(truth).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"), V.rounded(F.avg("pos")).alias("mean"))
    G.cached_statistics(spark, truth, cache, made)

    def again():
        raise AssertionError("the statistics should have been kept")

    return G.cached_statistics(spark, truth, cache, again)
