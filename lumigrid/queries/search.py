"""Similarity metrics in both semantics, and hybrid search in its modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.functions import vectors as V
from lumigrid.functions.registry import FEATURES
from lumigrid.operators import similarity as S
from lumigrid.plans import weights as W
from lumigrid.plans.corpus import corpus
from lumigrid.queries.base import CORPUS, k_sql, query, r6

QUERY_IDS = (1, 6, 8, 14, 65)  # 6: zero vector; 8: null scalar; 14: null vectors; 65: no entities, an empty list
IDS = ", ".join(map(str, QUERY_IDS))
COLUMNS = {"scalar": "brightness", "sharpness": "sharpness", "cosine": "hog_vector", "l2_color": "meta_moments_mean", "l2_cell": "meta_moments_mean", "category": "category", "entity": "entities"}

_dbl = lambda x: f"{x}::DOUBLE[]"
_l2 = lambda c: f"list_distance({_dbl('r.' + c)}, {_dbl('q.' + c)})"
_norm = lambda x: f"sqrt(list_sum(list_transform({_dbl(x)}, lambda v: v * v)))"
_dot = lambda a, b: f"list_dot_product({_dbl(a)}, {_dbl(b)})"
_cos = lambda c: f"({_dot('r.' + c, 'q.' + c)} / nullif({_norm('r.' + c)} * {_norm('q.' + c)}, 0))"
_low = lambda x: f"list_distinct(list_transform({x}, lambda e: lower(e)))"
_shared = f"len(list_intersect({_low('r.entities')}, {_low('q.entities')}))::DOUBLE"


def online_sql(metric: str, c: str) -> str:
    return {
        "scalar": k_sql(f"abs(r.{c} - q.{c})"),
        "sharpness": k_sql(f"abs(r.{c} - q.{c}) / (abs(r.{c} + q.{c}) + 1e-7)"),
        "cosine": k_sql(f"coalesce(1 - {_cos(c)}, 1.0)"),
        "l2_color": k_sql(f"{_l2(c)} / sqrt(255.0 * 255 * 3)"),
        "l2_cell": k_sql(f"coalesce({_l2(c)}, 0.0) / sqrt(255.0 * 255 * 3 * 16)"),
        "category": "CASE WHEN lower(r.category) = lower(coalesce(nullif(q.category, ''), 'General')) THEN 1.0 ELSE 0.0 END",
        "entity": f"CASE WHEN len(q.entities) > 0 AND r.entities IS NOT NULL THEN {k_sql(f'1 - {_shared} / greatest(1, len({_low("q.entities")}) + len(r.entities) - {_shared})')} ELSE 0.0 END",
    }[metric]


def offline_sql(metric: str, c: str) -> str:
    zero = f"coalesce({_l2(c)}, {_norm('r.' + c)}, {_norm('q.' + c)}, 0.0)"
    return {
        "scalar": k_sql(f"abs(coalesce(r.{c}, 0) - coalesce(q.{c}, 0))"),
        "sharpness": k_sql(f"abs(coalesce(r.{c}, 0) - coalesce(q.{c}, 0)) / (abs(coalesce(r.{c}, 0) + coalesce(q.{c}, 0)) + 1e-7)"),
        "cosine": k_sql(f"1 - coalesce({_dot('r.' + c, 'q.' + c)} / (({_norm('r.' + c)} + 1e-7) * ({_norm('q.' + c)} + 1e-7)), 0.0)"),
        "l2_color": k_sql(f"{zero} / sqrt(255.0 * 255 * 3)"),
        "l2_cell": k_sql(f"{zero} / coalesce(255 * sqrt(len(coalesce(r.{c}, q.{c}))), 1.0)"),
        "category": "CASE WHEN lower(coalesce(nullif(r.category, ''), 'General')) = lower(coalesce(nullif(q.category, ''), 'General')) THEN 1.0 ELSE 0.0 END",
        "entity": f"CASE WHEN len(r.entities) > 0 AND len(q.entities) > 0 THEN {k_sql(f'1 - {_shared} / greatest(len({_low("r.entities")}), len({_low("q.entities")}))')} ELSE 0.0 END",
    }[metric]


def _pairs_sql(expr: str) -> str:
    return f"SELECT q.id AS query_id, r.id AS id, {r6(expr)} AS sim FROM corpus q, corpus r WHERE q.id IN ({IDS})"


def _metric(metric: str, semantics: str):
    c = COLUMNS[metric]

    def run(spark, sf_dir):
        df = corpus(spark, sf_dir).select("id", F.col(c).alias("v"))
        q = df.where(F.col("id").isin(*QUERY_IDS)).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
        return df.join(F.broadcast(q), F.lit(True)).select("query_id", "id", V.rounded(S.METRICS[metric](F.col("v"), F.col("qv"), semantics)).alias("sim"))

    return run


for _m, _c in COLUMNS.items():
    query(f"metric_{_m}_online", _pairs_sql(online_sql(_m, _c)), CORPUS)(_metric(_m, "online"))
    query(f"metric_{_m}_offline", _pairs_sql(offline_sql(_m, _c)), CORPUS)(_metric(_m, "offline"))

#: The corpus columns' features, in the registry's order.
HELD = {"brightness": ("brightness", "scalar"), "sharpness": ("sharpness", "sharpness"), "meta_moments_mean": ("meta_moments_mean", "l2_cell"), "hog": ("hog_vector", "cosine"), "category": ("category", "category"), "entity": ("entities", "entity")}
MANUAL = {"brightness": 0.2, "hog": 1.5, "category": 0.5, "entity": 0.7, "unknown": 3.0, "sharpness": 0.0}
STORED = {"brightness": 0.1, "sharpness": 0.15, "meta_moments_mean": 0.2, "hog": 0.3, "category": 0.05, "entity": 0.2}


def _search_sql(weights: dict[str, float], limit: int, components: bool) -> str:
    cols = ", ".join(f"{r6(online_sql(m, c))} AS {n}_similarity" for n, (c, m) in HELD.items())
    raw = ", ".join(f"{online_sql(m, c)} AS s_{n}" for n, (c, m) in HELD.items() if n in weights)
    total = " + ".join(f"s_{n} * {w!r}" for n, w in weights.items() if n in HELD) or "0.0"
    out = ", " + ", ".join(f"{n}_similarity" for n in HELD) if components else ""
    return f"""SELECT query_id, id, file_name, similarity, rank{out} FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
        SELECT *, {r6(total)} AS similarity FROM (SELECT q.id AS query_id, r.id, r.file_name, {raw}{", " + cols if components else ""} FROM corpus q, corpus r WHERE q.id IN ({IDS}))))
      WHERE rank <= {limit}"""


def _run_search(weights: dict[str, float], limit: int, components: bool):
    def run(spark, sf_dir):
        df = corpus(spark, sf_dir)
        out = S.search(df, df.where(F.col("id").isin(*QUERY_IDS)), weights, limit, components=components, places=6)
        return out.select("query_id", "id", "file_name", "similarity", "rank", *([V.rounded(F.col(f"{n}_similarity")).alias(f"{n}_similarity") for n in HELD] if components else []))

    return run


_manual = W.resolved("manual", MANUAL)
_optimized = W.resolved("optimized", stored=STORED)
_equal = W.resolved("equal")
query("search_manual", _search_sql(_manual, 20, True), CORPUS)(_run_search(_manual, 20, True))
query("search_optimized", _search_sql(_optimized, W.limit_of(None), False), CORPUS)(_run_search(_optimized, W.limit_of(None), False))
query("search_equal", _search_sql(_equal, 20, False), CORPUS)(_run_search(_equal, 20, False))
query("search_unweighted", _search_sql({}, 5, False), CORPUS)(_run_search(W.resolved("manual", {"unknown": 1.0}), 5, False))


@query("search_two_stage", f"""SELECT query_id, id, file_name, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
    SELECT q.id AS query_id, r.id, r.file_name, {r6("0.5 * " + _cos("dreamsim_vector") + " + 0.5 * (" + online_sql("scalar", "brightness") + " * 0.6 + " + online_sql("category", "category") + " * 0.4)")} AS similarity
    FROM corpus q, corpus r WHERE q.id IN (1, 3) AND {_cos("dreamsim_vector")} > 0.1)) WHERE rank <= 10""", CORPUS)
def search_two_stage(spark, sf_dir):
    df = corpus(spark, sf_dir)
    return S.two_stage(df, df.where(F.col("id").isin(1, 3)), "dreamsim_vector", {"brightness": 0.6, "category": 0.4}, 10, least=0.1, places=6).select("query_id", "id", "file_name", "similarity", "rank")


@query("score_scaling", f"""SELECT id, round(coalesce(s, 0) * 100, 2) + 0.0 AS score FROM (
  SELECT id, CASE WHEN brightness IS NOT NULL THEN round({k_sql("abs(brightness - 0.1)")}, 6) END AS s FROM corpus)""", CORPUS)
def score_scaling(spark, sf_dir):
    s = F.when(F.col("brightness").isNotNull(), F.round(V.kernel(F.abs(F.col("brightness") - 0.1)), 6))
    return corpus(spark, sf_dir).select("id", S.scaled(s).alias("score"))


@query("kernel_cases", f"SELECT d, {r6(k_sql('d'))} AS k FROM (VALUES (NULL::DOUBLE), (0.0), (0.5), (1.0), (2.0), (-1.0)) t(d)")
def kernel_cases(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in (None, 0.0, 0.5, 1.0, 2.0, -1.0)], "d double").select("d", V.rounded(V.kernel(F.col("d"))).alias("k"))


@query("feature_registry", "SELECT name, grp, dim FROM (VALUES " + ", ".join(f"('{f.name}', '{f.group}', {f.dim})" for f in FEATURES.values() if f.group in ("deep", "color")) + ") t(name, grp, dim)")
def feature_registry(spark, sf_dir):
    rows = spark.createDataFrame([(f.name, f.group, f.dim) for f in FEATURES.values()], "name string, grp string, dim int")
    return rows.where(F.col("grp").isin("deep", "color"))


@query("weight_normalization", "SELECT k AS feature, w / sum(w) OVER () AS weight FROM (VALUES ('a', 1.0::DOUBLE), ('b', 3.0::DOUBLE), ('c', 4.0::DOUBLE)) t(k, w)")
def weight_normalization(spark, sf_dir):
    got = W.normalized({"a": 1.0, "b": 3.0, "c": 4.0})
    return spark.createDataFrame(list(got.items()), "feature string, weight double")
