"""Similarity expressions by metric, their weighted sum, and hybrid top-k search.

Two semantics differ in how they treat nulls and sizes: "online" compares one query's values with the columns of a
table; "offline" compares two rows after nulls have become zeros.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumigrid.functions import vectors as V
from lumigrid.functions.registry import FEATURES

TINY = 1e-7
#: Query rows of a search, which are broadcast, at most: of the widest rows about 10 MB.
QUERIES = 256
#: Distances at which color vectors count as entirely different, online.
MAX_COLOR, MAX_CELL = math.sqrt(255 * 255 * 3), math.sqrt(255 * 255 * 3 * 16)


def scalar(a: Column, b: Column, semantics: str = "online") -> Column:
    if semantics == "offline":
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return V.kernel(F.abs(a - b))


def sharpness(a: Column, b: Column, semantics: str = "online") -> Column:
    if semantics == "offline":
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return V.kernel(F.abs(a - b) / (F.abs(a + b) + TINY))


def cosine(a: Column, b: Column, semantics: str = "online", held: tuple[Column, Column] | None = None) -> Column:
    """Null or zero vectors have similarity 0 online; offline they are zero vectors, with norms a little above 0. held: their
    norms, where these are known."""
    if semantics == "online":
        return V.kernel(F.coalesce(1.0 - V.cosine(a, b, *(held or ())), F.lit(1.0)))
    return V.kernel(1.0 - F.coalesce(V.dot(a, b) / ((V.norm(a) + TINY) * (V.norm(b) + TINY)), F.lit(0.0)))


def l2_color(a: Column, b: Column, semantics: str = "online") -> Column:
    d = V.l2(a, b)
    return V.kernel((d if semantics == "online" else F.coalesce(d, V.norm(a), V.norm(b), F.lit(0.0))) / MAX_COLOR)


def l2_cell(a: Column, b: Column, semantics: str = "online") -> Column:
    """Online a null distance is 0; offline a null vector is a zero one, and the scale follows the dimension."""
    if semantics == "online":
        return V.kernel(F.coalesce(V.l2(a, b), F.lit(0.0)) / MAX_CELL)
    dim = F.size(F.coalesce(a, b)).cast("double")
    return V.kernel(F.coalesce(V.l2(a, b), V.norm(a), V.norm(b), F.lit(0.0)) / F.coalesce(255.0 * F.sqrt(dim), F.lit(1.0)))


def category(a: Column, b: Column, semantics: str = "online") -> Column:
    """a is the table's column and b the query's value; a missing query value is 'general'."""
    said = lambda c: F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("General")))
    same = (F.lower(a) == said(b)) if semantics == "online" else (said(a) == said(b))
    return F.when(same, 1.0).otherwise(0.0)


def lowered(c: Column) -> Column:
    return F.array_distinct(F.transform(c, F.lower))


def entity(a: Column, b: Column, semantics: str = "online", held: tuple[Column, Column] | None = None) -> Column:
    """Online: shared entities over the union, which counts the row's duplicates; offline: over the larger set. held: both
    lowered(), where these are known."""
    rs, qs = held or (lowered(a), lowered(b))
    shared = F.size(F.array_intersect(rs, qs)).cast("double")
    if semantics == "online":
        union = F.size(qs) + F.size(a) - shared
        sim = V.kernel(1.0 - F.coalesce(shared / F.greatest(F.lit(1.0), union), F.lit(0.0)))
        return F.when(F.coalesce(F.size(qs) > 0, F.lit(False)) & a.isNotNull(), sim).otherwise(0.0)
    both = F.coalesce((F.size(a) > 0) & (F.size(b) > 0), F.lit(False))
    return F.when(both, V.kernel(1.0 - shared / F.greatest(F.size(rs), F.size(qs)))).otherwise(0.0)


METRICS = {"scalar": scalar, "sharpness": sharpness, "cosine": cosine, "l2_color": l2_color, "l2_cell": l2_cell, "category": category, "entity": entity}


def feature_columns(df: DataFrame) -> dict[str, tuple[str, str]]:
    """(column, metric) of the registry's features that a table has."""
    return {n: (f.column, f.metric) for n, f in FEATURES.items() if f.column in df.columns}


def similarities(features: dict[str, tuple[str, str]], query: str = "q", row: str = "r", semantics: str = "online") -> dict[str, Column]:
    """A similarity expression for each feature, between the aliases query and row."""
    return {n: METRICS[m](F.col(f"{row}.{c}"), F.col(f"{query}.{c}"), semantics) for n, (c, m) in features.items()}


#: What search() works out once for each row, and once for each query, before they meet.
HELD = {"cosine": V.norm, "entity": lowered}


def holding(df: DataFrame, features: dict[str, tuple[str, str]]) -> list[Column]:
    return [HELD[m](F.col(c)).alias(f"__{m}_{c}") for c, m in sorted(set(features.values())) if m in HELD]


def held_similarities(features: dict[str, tuple[str, str]], query: str = "q", row: str = "r", semantics: str = "online") -> dict[str, Column]:
    """similarities() of rows and queries with what holding() adds."""
    more = lambda c, m: {"held": (F.col(f"{row}.__{m}_{c}"), F.col(f"{query}.__{m}_{c}"))} if m in HELD else {}
    return {n: METRICS[m](F.col(f"{row}.{c}"), F.col(f"{query}.{c}"), semantics, **more(c, m)) for n, (c, m) in features.items()}


def weighted(sims: dict[str, Column], weights: dict[str, float]) -> Column:
    parts = [sims[n] * F.lit(float(w)) for n, w in weights.items() if w != 0 and n in sims]
    return reduce(add, parts) if parts else F.lit(0.0)


def handful(queries: DataFrame, most: int = QUERIES) -> DataFrame:
    """queries, which fail when they are run if they have more than `most` rows: what is broadcast has a proven bound."""
    few = queries.limit(most + 1).withColumn("__n", F.row_number().over(Window.orderBy("id")))  # of most + 1 rows at most
    refused = F.raise_error(F.lit(f"more than {most} query rows: search in batches")).cast(queries.schema["id"].dataType)
    return few.withColumn("id", F.when(F.col("__n") > most, refused).otherwise(F.col("id"))).drop("__n")


def search(table: DataFrame, queries: DataFrame, weights: dict[str, float], limit: int, semantics: str = "online", components: bool = True, places: int | None = None) -> DataFrame:
    """(query_id, id, file_name, rank, similarity, <feature>_similarity ...): each query's `limit` best rows.

    queries is a handful of rows (at most QUERIES) with the table's columns, joined as constants; the table is scanned once, only the
    columns of weighted features (all, with components) are read, and ranks come from a group-limited window.
    """
    features = feature_columns(table)
    used = features if components else {n: f for n, f in features.items() if n in weights}
    keep = sorted({c for c, _ in used.values()})
    q = handful(queries).select("id", *keep, *holding(queries, used)).alias("q")
    sims = held_similarities(used, semantics=semantics)
    cols = [s.alias(f"{n}_similarity") for n, s in sims.items()]
    scored = table.select("id", "file_name", *keep, *holding(table, used)).alias("r").join(F.broadcast(q), F.lit(True)).select(F.col("q.id").alias("query_id"), F.col("r.id").alias("id"), F.col("r.file_name").alias("file_name"), *cols)
    total = weighted({n: F.col(f"{n}_similarity") for n in used}, weights)
    scored = scored.withColumn("similarity", V.rounded(total, places) if places is not None else total)
    return ranked(scored, "query_id", limit) if components else ranked(scored.drop(*[f"{n}_similarity" for n in used]), "query_id", limit)


def ranked(scored: DataFrame, by: str, limit: int, score: str = "similarity") -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(by).orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def two_stage(table: DataFrame, query: DataFrame, vector: str, weights: dict[str, float], limit: int, least: float = 0.3, places: int | None = None) -> DataFrame:
    """Rows whose cosine with the query exceeds `least`, scored half by it and half by the weighted features."""
    features = {n: f for n, f in feature_columns(table).items() if n in weights}
    keep = sorted({vector, *(c for c, _ in features.values())})
    r, q = table.select("id", "file_name", *keep).alias("r"), F.broadcast(handful(query).select("id", *keep).alias("q"))
    near = r.join(q, F.lit(True)).withColumn("near", V.cosine(F.col(f"r.{vector}"), F.col(f"q.{vector}"))).where(F.col("near") > least)
    score = 0.5 * F.col("near") + 0.5 * weighted(similarities(features), weights)
    out = near.select(F.col("q.id").alias("query_id"), F.col("r.id").alias("id"), F.col("r.file_name").alias("file_name"), (V.rounded(score, places) if places is not None else score).alias("similarity"))
    return ranked(out, "query_id", limit)


def scaled(sim: Column) -> Column:
    """A similarity as a percentage with two places; null is 0."""
    return F.round(F.coalesce(sim, F.lit(0.0)) * 100, 2) + F.lit(0.0)
