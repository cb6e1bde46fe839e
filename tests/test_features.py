"""The store of features: one packing for all trials, broken features reported, versions, other block sizes."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import evaluation, flows, optimize, products
from lumigrid.operators.features import FeatureStore, pieces

FEATURES = {"brightness": ("brightness", "scalar"), "hog": ("hog", "cosine"), "category": ("category", "category"), "entity": ("entities", "entity"), "color": ("color", "l2_color")}
VECTORS = [dict.fromkeys(FEATURES, 1.0), {"hog": 0.5, "category": 0.3, "entity": 0.2}, {"color": 1.0}]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    rows = [
        (i, i % 3 if i % 11 else None, f"x/{i}.jpg", None if i % 7 == 0 else float(rng.random()), [float(a) for a in rng.normal(size=4)] if i % 8 else None, str(rng.choice(["Car", "car", "", "Tree"])),
         [str(e) for e in rng.choice(list("abcAB"), 3)] if i % 5 else None, [float(a) for a in rng.random(3) * 200] if i % 6 else None, [1.0] * (2 + (i == 9)), [1.0] * (2 + i // 20))
        for i in range(60)
    ]
    path = str(tmp_path_factory.mktemp("features") / "source")
    spark.createDataFrame(rows, "id long, label int, file_name string, brightness double, hog array<float>, category string, entities array<string>, color array<float>, ragged array<float>, uneven array<float>").write.parquet(path)
    return path


def maps(df):
    return {r["trial"]: (round(r["map"], 9), r["n"]) for r in df.collect()}


def test_trials_over_a_store_equal_those_over_rows_and_read_no_source(spark, source, tmp_path):
    mine = str(tmp_path / "rows")
    shutil.copytree(source, mine)
    df = spark.read.parquet(mine)
    want = maps(optimize.trials(df, FEATURES, VECTORS, size=11))
    kept = FeatureStore(spark, f"file://{tmp_path}/store").build(df, FEATURES, size=11)
    assert sorted(kept.features()) == sorted(FEATURES) and kept.errors() == {} and kept.count() == 60
    shutil.rmtree(mine)  # the source is gone: nothing reads it again
    for size in (11, 4, products.SIZE):
        assert maps(optimize.trials(kept, FEATURES, VECTORS, size=size)) == want
    files = optimize.trials(kept, FEATURES, [{"hog": 1.0}]).inputFiles()
    assert files and all("__feature=hog" in f or "__feature=__rows" in f for f in files)  # no other feature is read


def test_a_broken_feature_is_reported_and_left_out(spark, source, tmp_path):
    df = spark.read.parquet(source)
    broken = FEATURES | {"gone": ("gone", "scalar"), "words": ("category", "cosine"), "ragged": ("ragged", "cosine"), "uneven": ("uneven", "cosine")}
    kept = FeatureStore(spark, f"file://{tmp_path}/store").build(df, broken, size=4)
    assert sorted(kept.features()) == sorted(FEATURES)
    errors = kept.errors()
    assert sorted(errors) == ["gone", "ragged", "uneven", "words"]
    assert "gone" in errors["gone"] and "string" in errors["words"] and "ValueError" in errors["ragged"]
    want = maps(optimize.trials(df, FEATURES, VECTORS))
    assert maps(optimize.trials(kept, broken, [v | {"ragged": 0.5, "gone": 1.0} for v in VECTORS])) == want
    best, base, top = optimize.optimize(kept, broken, n_trials=4, batch=4)
    assert sorted(best) == sorted(FEATURES) and top >= base
    with pytest.raises(KeyError):
        kept.blocks(["ragged"])


def test_versions_and_added_features(spark, source, tmp_path):
    df, path = spark.read.parquet(source), f"file://{tmp_path}/store"
    first = FeatureStore(spark, path).build(df, {"hog": FEATURES["hog"], "color": ("gone", "l2_color")}, size=16)
    second = first.add(df, {"color": FEATURES["color"]})
    assert first.features() == ["hog"] and sorted(second.features()) == ["color", "hog"] and second.errors() == {}
    assert FeatureStore(spark, path).version == second.version == 1 and FeatureStore(spark, path, 0).features() == ["hog"]
    used = {n: FEATURES[n] for n in ("hog", "color")}
    assert maps(optimize.trials(second, used, [{"hog": 0.5, "color": 0.5}])) == maps(optimize.trials(df, used, [{"hog": 0.5, "color": 0.5}]))
    with pytest.raises(ValueError, match="changed"):
        second.add(df.where("id <> 5"), {"entity": FEATURES["entity"]})
    assert FeatureStore(spark, path).version == 1  # what failed is no version


def test_listing_nulls_and_empty_tables(spark, source, tmp_path):
    df = spark.read.parquet(source)
    listing = spark.createDataFrame([(f"elsewhere/{i}.jpg",) for i in range(0, 60, 2)], "file_name string")
    kept = FeatureStore(spark, f"file://{tmp_path}/a").build(df, FEATURES, listing=listing)
    assert kept.count() == 30 and maps(optimize.trials(kept, FEATURES, VECTORS)) == maps(optimize.trials(df.where("id % 2 = 0"), FEATURES, VECTORS))
    nulls = df.withColumn("id", F.when(F.col("id") != 3, F.col("id"))).withColumn("hog", F.lit(None).cast("array<float>")).withColumn("block", F.lit("clash"))
    kept = FeatureStore(spark, f"file://{tmp_path}/b").build(nulls, FEATURES)
    assert kept.count() == 59 and "hog" in kept.features() and maps(optimize.trials(kept, FEATURES, VECTORS))
    empty = FeatureStore(spark, f"file://{tmp_path}/c").build(df.limit(0), FEATURES)
    assert empty.count() == 0 and maps(optimize.trials(empty, FEATURES, VECTORS)) == {}


def test_evaluation_and_learning_over_a_store(spark, source, tmp_path):
    df = spark.read.parquet(source)
    kept, w = FeatureStore(spark, f"file://{tmp_path}/store").build(df, FEATURES, size=16), {"hog": 0.6, "entity": 0.4}
    used = {n: FEATURES[n] for n in w}
    columns, score = products.columns_of(used), flows.weighted_score(used, w)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(evaluation.all_ap_full(kept, columns, score)) == rows(evaluation.all_ap_full(df, columns, score))
    assert rows(evaluation.top_ranks(kept, columns, score, 3)) == rows(evaluation.top_ranks(df, columns, score, 3))
    members = df.where("label is not null").select(F.col("label").cast("string").alias("cluster_key"), "file_name")
    equal, learnt = flows.learned(df, used | {"gone": ("gone", "scalar")}, members, n_trials=4)
    assert set(equal["metrics"].first()["weights"]) == set(w) and learnt["metrics"].first()["test_map5_after"] >= equal["metrics"].first()["test_map5_after"]


def test_pieces_hold_every_row_once():
    arrays = {"id": np.arange(7), "v": np.arange(14.0).reshape(7, 2), "*e": np.arange(6), "*e?size": np.array([2, 0, 1, 0, 3, 0, 0])}
    got = pieces(arrays, 3)
    assert all(np.array_equal(np.concatenate([p[k] for p in got]), arrays[k]) for k in arrays)
    assert all(p["*e?size"].sum() == len(p["*e"]) and len(p["v"]) == len(p["id"]) for p in got)
