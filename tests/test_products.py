"""Blocks that meet: nothing is shuffled for it, and screened scores give the same best rows."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import evaluation, products
from lumigrid.queries import catalogue


def block(rng, ids):
    return {"id": np.sort(ids), "b": np.round(rng.random(len(ids)), 1) * 1e6, "v": np.round(rng.normal(size=(len(ids), 6)), 1), "c": rng.integers(0, 3, len(ids)), "label": rng.integers(0, 4, len(ids)), "known": rng.random(len(ids)) > 0.1}


def test_screened_scores_give_the_best_of_all(monkeypatch):
    rng = np.random.default_rng(1)
    metrics = {"b": "scalar", "v": "cosine", "c": "category"}
    vectors = [{"b": 0.2, "v": 0.5, "c": 0.3}, {"v": 1.0}, {"c": 1.0}, {"b": 1.0, "c": -1.0}]
    blocks = [block(rng, ids) for ids in np.split(rng.permutation(1200), 4)]
    scores, q = products.Scores(metrics, vectors), blocks[0]
    screened = []
    real = products.Scores._screened
    monkeypatch.setattr(products.Scores, "_screened", lambda self, *a: screened.append(real(self, *a)) or screened[-1])
    got, want = ([products.Best(len(q["id"]), 5) for _ in vectors] for _ in range(2))
    for c in blocks:
        y = evaluation._relevant(q, c)
        assert (evaluation.relevant_rows(q, c) == y.sum(1)).all()
        scores.offer(got, q, c, evaluation.relevance_of(q, c), 6)
        for best, s in zip(want, scores.all(q, c), strict=True):
            best.add(products.whole(s, 6), c["id"], y, q["id"][:, None] == c["id"][None, :])
    for a, b in zip(got, want, strict=True):
        assert (a.score == b.score).all() and (a.id == b.id).all() and (a.y == b.y).all()
    scores = products.Scores({"v": "cosine"}, [{"v": 1.0}])
    best = [products.Best(len(q["id"]), 5)]
    for c in blocks:
        scores.offer(best, q, c, evaluation.relevance_of(q, c), 6)
    assert any(s is not None for s in screened)


def test_weights_that_one_metric_cant_tell_apart_leave_few_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    metrics = {"b": "scalar", "v": "cosine", "c": "category"}
    vectors = [{"b": 0.46, "v": w, "c": 0.54 - w} for w in (0.003, 0.02, 0.1, 0.3)]

    def some(ids):
        v = rng.normal(size=(len(ids), 16)) * (rng.random(len(ids)) > 0.02)[:, None]
        return {"id": np.sort(ids), "b": np.abs(rng.normal(size=len(ids))) / 8, "v": v, "c": rng.integers(0, 5, len(ids)), "label": rng.integers(0, 9, len(ids)), "known": rng.random(len(ids)) > 0.1}

    blocks, exact = [some(ids) for ids in np.split(rng.permutation(16_384), 8)], []
    got, want = ([products.Best(2048, 5) for _ in vectors] for _ in range(2))
    scores, q, add = products.Scores(metrics, vectors), blocks[0], products.Best.add
    for c in blocks:
        for best, s in zip(want, scores.all(q, c), strict=True):
            best.add(products.whole(s, 6), c["id"], evaluation._relevant(q, c), q["id"][:, None] == c["id"][None, :])
    monkeypatch.setattr(products.Best, "add", lambda self, score, *a: exact.append(score.size) or add(self, score, *a))
    for c in blocks:
        scores.offer(got, q, c, evaluation.relevance_of(q, c), 6)
    for a, b in zip(got, want, strict=True):
        assert (a.score == b.score).all() and (a.id == b.id).all() and (a.y == b.y).all()
    assert sum(exact) < 0.1 * len(vectors) * 2048 * 16_384  # pairs that were scored for a whole block


def test_meeting_blocks_shuffles_none(spark):
    df = spark.range(300).select("id", (F.col("id") % 5).alias("label"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("v"))
    for got in (evaluation.top_ranks(df, {"v": F.col("v")}, evaluation.cosines, 3, size=64), evaluation.all_ap_full(df, {"v": F.col("v")}, evaluation.cosines, size=64)):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() >= 300


def moved(spark, run):
    """Bytes that run() shuffles, spills and writes, by its stages."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = max(stages(), default=-1)
    run()
    return sum(x for k, x in stages().items() if k > before)


@pytest.mark.parametrize("name", ["eval_report", "eval_worst_five", "eval_ap_at_5"])
def test_what_ranks_move_grows_as_the_rows(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(evaluation, "top_ranks", functools.partial(evaluation.top_ranks, size=64))
    vector, made = F.array(*[F.sin(F.col("id") * (k + 1) + F.lit(k * k)).cast("float") for k in range(16)]), {}
    for rows in (512, 2048):  # 8 and 32 blocks
        d = str(tmp_path / str(rows))
        spark.range(rows).select(F.col("id").alias("vec_id"), vector.alias("embedding"), (F.col("id") % 7).cast("int").alias("label")).write.parquet(f"{d}/embeddings.parquet")
        out = f"{d}/{name}"
        made[rows] = moved(spark, lambda d=d, out=out: catalogue.queries()[name](spark, d).write.parquet(out))
        assert spark.read.parquet(out).count() == (5 if name == "eval_worst_five" else rows)
    assert 0 < made[2048] < 5 * made[512]


def test_counts_of_bounded_scores_equal_sorted_ones(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "WAITING", 100)
    known = F.when(F.col("id") % 7 > 0, F.col("id") % 5)
    df = spark.range(400).select("id", known.alias("label"), F.when(F.col("id") == 5, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.sin("id"), F.cos(F.col("id") * 3))).alias("v"))
    sorted_ = lambda q, c: evaluation.cosines(q, c)
    for f in (evaluation.all_ap_full, evaluation.all_pr_points):
        got, want = (sorted(map(tuple, f(df, {"v": F.col("v")}, s, size=64).collect())) for s in (evaluation.cosines, sorted_))
        assert len(got) > 300 and np.allclose(got, want, rtol=0, atol=1e-12)
    held = evaluation.Counts(3, 10_000)
    for _ in range(500):  # what a task holds doesn't grow with the rows it meets
        held.add(np.zeros((3, 1000)), np.zeros((3, 1000), dtype=bool), np.array([0]), np.array([0]))
    held.settle()
    assert held.counts.nbytes + sum(x.nbytes for x in held.waiting) < 2_000_000 and held.counts.sum() == 500 * 2999


def test_blocks_stay_whole_where_tasks_hold_fewer_queries(spark, monkeypatch):
    from lumigrid.operators import flows, optimize

    rows, numbers, by_number = 1024, [], evaluation.shared.by_number
    kind = F.element_at(F.array(F.lit("Car"), F.lit("car"), F.lit(""), F.lit("Tree")), (F.col("id") % 4 + 1).cast("int"))
    vector = F.when(F.col("id") % 50 > 0, F.array(*[F.sin(F.col("id") * (k + 1) + F.lit(k * k)) for k in range(6)]))
    df = spark.range(rows).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("label"), (F.abs(F.sin("id")) * 3).alias("b"), (F.abs(F.cos("id")) / 9).alias("near"), vector.alias("v"), kind.alias("kind"))
    features, w = {"b": ("b", "scalar"), "near": ("near", "scalar"), "sharp": ("b", "sharpness"), "v": ("v", "cosine"), "kind": ("kind", "category")}, {"b": 0.2, "near": 0.1, "sharp": 0.15, "v": 0.3, "kind": 0.25}
    sim = F.round(sum((F.col(n) * w[n] for n in w), F.lit(0.0)), 6) + F.lit(0.0)
    pairs = optimize.pair_table(df, df, features).select("q", "c", F.coalesce("y", F.lit(0)).alias("y"), sim.alias("sim"))
    monkeypatch.setattr(evaluation, "ENTRIES", 16 * rows)
    monkeypatch.setattr(evaluation.shared, "by_number", lambda *a: numbers.append(by_number(*a)) or numbers[-1])
    got = dict(map(tuple, evaluation.all_ap_full(df, products.columns_of(features), flows.weighted_score(features, w), places=6).collect()))
    assert got == pytest.approx(dict(map(tuple, evaluation.ap_full(pairs).collect())), abs=1e-9) and len(got) > 800
    assert len(numbers[-1][1]) <= 8  # not 64 blocks, each of which every task would read


def test_sample_without_sorting_pairs(spark):
    rows = spark.range(-3, 300).select("id", F.when(F.col("id") % 11 > 0, F.col("id") % 6 + F.when(F.col("id") > 200, 7).otherwise(0)).alias("label"))
    q = rows.where("id % 10 = 0")
    a, b = q.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("q"), F.col("b.id").alias("c"), (F.col("a.label") == F.col("b.label")).cast("int").alias("y"), F.lit(0.0).alias("sim"))
    want = sorted(map(tuple, evaluation.separation_sample(pairs).select("q", "c", "y").collect()))
    got = evaluation.all_separation_sample(q, rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_images_of_one_name_all_stay_by_whole_names(spark):
    from lumigrid.operators import optimize

    images = spark.createDataFrame([(1, "a/x.jpg"), (2, "b/x.jpg"), (3, "a/x.jpg"), (4, "c/y.jpg")], "id long, file_name string").withColumn("label", F.lit("old"))
    members = spark.createDataFrame([("1", 0, "a/x.jpg"), ("1", 1, "a/x.jpg"), ("2", 0, "b/x.jpg")], "cluster_key string, pos long, file_name string")
    got = optimize.store(images, members, whole=True)
    assert sorted((r["id"], r["label"]) for r in got.collect()) == [(1, "1"), (2, "2"), (3, "1")]
    assert optimize.store(images, members).count() == 1
