"""Flows over an image table against what they must leave behind, products of blocks against plain NumPy, and JDBC."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import extractors as X
from lumigrid.functions.registry import image_schema
from lumigrid.operators import evaluation, flows, groundtruth, optimize, products
from lumigrid.sources import tables
from tests.test_engine import bmp


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    shots = {n: rng.integers(0, 256, (12, 18, 3), dtype=np.uint8) for n in ("a.bmp", "b.bmp", "c.bmp")}
    (path / "sub dir").mkdir()
    for n, img in shots.items():
        (path / n.replace(".bmp", ".png")).write_bytes(bmp(img))
    (path / "sub dir" / "copy of a.jpg").write_bytes(bmp(shots["a.bmp"]))
    (path / "broken.jpeg").write_bytes(b"no image")
    return str(path), {n.replace(".bmp", ".png"): img for n, img in shots.items()}


def analyse(names):
    return [{"category": f"C{n[0]}", "description": f"of {n}", "entities": [n, "x"]} for n in names]


def embed_text(texts):
    return [[float(len(t)), 3.0, 4.0] for t in texts]


def embed_image(contents):
    return [[float(len(c)), float(c[-1])] for c in contents]


def test_embeddings_fall_back_one_by_one(spark):
    df = spark.createDataFrame([(1, "aa"), (2, None), (3, ""), (4, "bad"), (5, "c")], "id long, t string").coalesce(1)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    got = {r["id"]: r["vector"] for r in flows.embedded(df, "id", "t", embed, normalize=True).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[5] == pytest.approx([0.6, 0.8]) and got[2] is got[3] is got[4] is None
    assert flows.embedded(df.limit(0), "id", "t", embed).count() == 0


def test_import_of_a_folder(spark, folder):
    path, shots = folder
    empty = spark.createDataFrame([], image_schema())
    args = {"analyse": analyse, "embed_text": embed_text, "embed_image": embed_image}
    new = flows.imported(spark, path, empty, **args)
    assert new.schema.fieldNames() == image_schema().fieldNames()
    rows = {r["file_name"]: r for r in new.collect()}
    assert sorted(rows) == ["a.png", "b.png", "c.png"]  # the copy is the same file, and the broken one doesn't decode
    assert sorted(r["id"] for r in rows.values()) == [1, 2, 3]
    small = X.resized(shots["b.png"], 2, 3)
    r = rows["b.png"]
    assert r["brightness"] == pytest.approx(float(np.atleast_1d(X.brightness(small))[0]), abs=1e-5) and len(r["hog_vector"]) == 1568
    assert (r["width"], r["height"], r["category"], r["entities"]) == (18, 12, "Cb", ["b.png", "x"])
    assert np.linalg.norm(r["llm_embedding"]) == pytest.approx(1.0) and len(r["dreamsim_vector"]) == 2 and r["file_hash"] and r["created_at"]
    some = spark.createDataFrame([rows["a.png"]], image_schema())
    again = flows.imported(spark, path, some, **args).collect()
    assert sorted(r["id"] for r in again) == [rows["a.png"]["id"] + 1, rows["a.png"]["id"] + 2] and {r["file_name"] for r in again} == {"b.png", "c.png"}
    assert flows.imported(spark, path, new, **args).count() == 0


def test_queries_are_standardised_on_request_only(spark, folder):
    path, shots = folder
    files = flows.scanned(spark, path).where("file_name = 'b.png'")
    size = (8, 8)
    features = ("brightness", "edge_density")
    plain = flows.queried(spark, path, files, analyse, features=features).first()
    same = flows.queried(spark, path, files, analyse, features=features, standardize_query=True, size=size).first()
    empty = spark.createDataFrame([], image_schema())
    stored = {s: flows.imported(spark, path, empty, analyse, features=features, files=files, standard=s).first() for s in (None, size)}
    assert plain["id"] == 0 and plain["brightness"] == stored[None]["brightness"] and same["brightness"] == stored[size]["brightness"]
    assert plain["edge_density"] == stored[None]["edge_density"] and same["brightness"] != plain["brightness"]


def test_best_images_are_copied_by_cluster(spark, folder, tmp_path):
    path, _ = folder
    aps = spark.createDataFrame([("a.png", 0.5), ("x/b.png", 0.9), ("c.png", 0.49), ("copy of a.jpg", 1.0), ("lost.png", 1.0), (None, 1.0)], "file_name string, ap double")
    members = spark.createDataFrame([(1, "a.png"), (1, "c.png"), (2, "b.png"), (2, "a.png"), (2, "copy of a.jpg"), (3, "lost.png"), (3, "unknown.png")], "cluster_key int, file_name string")
    listing = flows.scanned(spark, path).select(F.col("file_name").alias("path"))
    got = flows.exported_best(aps, members, listing, path, str(tmp_path / "best")).collect()
    made = {(r["cluster_id"], r["dst"].rsplit("/", 1)[1]) for r in got if r["error"] is None}
    assert made == {("1", "a.png"), ("2", "a.png"), ("2", "b.png"), ("2", "copy of a.jpg")}
    assert [(r["cluster_id"], r["error"]) for r in got if r["error"]] == [("3", "no such file is known")]
    assert sorted(str(p.relative_to(tmp_path / "best")) for p in (tmp_path / "best").glob("[0-9]*/*")) == ["1/a.png", "2/a.png", "2/b.png", "2/copy of a.jpg"]
    chosen = spark.createDataFrame([(1, ["a.png", "sub dir/copy of a.jpg"]), (2, ["b.png"])], "ordinal int, images array<string>")
    done = flows.exported_clusters(chosen, path, str(tmp_path / "chosen")).collect()
    assert len(done) == 3 and not any(r["error"] for r in done)
    assert sorted(str(p.relative_to(tmp_path / "chosen")) for p in (tmp_path / "chosen").glob("cluster*/*")) == ["cluster_01/a.png", "cluster_01/copy of a.jpg", "cluster_02/b.png"]


def test_synchronize(spark, folder):
    path, _ = folder
    args = {"analyse": analyse, "embed_text": embed_text}
    whole = flows.imported(spark, path, spark.createDataFrame([], image_schema()), embed_image=embed_image, **args)
    kept = {r["file_name"]: r.asDict() for r in whole.collect()}
    kept["a.png"]["dreamsim_vector"] = [0.0, 0.0]
    kept["b.png"]["file_hash"] = None
    stored = spark.createDataFrame([kept["a.png"], kept["b.png"]], image_schema())
    after, actions = flows.synchronized(spark, path, stored, embed_image, **args)
    assert {r["file_name"]: r["action"] for r in actions.collect()} == {"a.png": "FIX", "sub dir/copy of a.jpg": "FIX", "b.png": "UPDATE_HASH", "c.png": "PROCESS", "broken.jpeg": "PROCESS"}
    rows = {r["file_name"]: r for r in after.collect()}
    assert sorted(rows) == ["a.png", "b.png", "c.png"] and after.count() == 3
    assert any(rows["a.png"]["dreamsim_vector"]) and rows["b.png"]["file_hash"] and rows["c.png"]["id"] == max(kept["a.png"]["id"], kept["b.png"]["id"]) + 1


def test_complete_semantics(spark):
    schema = "id long, file_name string, category string, description string, entities array<string>, llm_embedding array<float>, other int"
    rows = [(1, "a", None, "d", None, None, 7), (2, "b", "C", "d", ["e"], [1.0], 8), (3, "gone", "", None, None, None, 9)]
    stored, files = spark.createDataFrame(rows, schema), spark.createDataFrame([("a",), ("b",)], "file_name string")
    got = {r["id"]: r for r in flows.completed(stored, files, analyse, embed_text).collect()}
    assert got[1]["category"] == "Ca" and got[1]["llm_embedding"] and got[2]["category"] == "C" and got[3]["category"] == "" and got[3]["other"] == 9
    every = {r["id"]: r for r in flows.completed(stored, files, analyse, embed_text, everything=True).collect()}
    assert every[2]["category"] == "Cb" and every[3]["description"] is None


def test_statistics_are_cached_by_the_time_of_the_ground_truth(spark, tmp_path):
    gt, calls = tmp_path / "gt.json", []
    gt.write_text("{}")

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    for _ in range(2):
        assert groundtruth.cached_statistics(spark, str(gt), str(tmp_path / "cache"), compute).count() == 1
    assert len(calls) == 1
    assert groundtruth.cached_statistics(spark, str(gt), str(tmp_path / "cache"), compute, force=True).count() == 2
    import os

    os.utime(gt, (1, 1))
    assert groundtruth.cached_statistics(spark, str(gt), str(tmp_path / "cache"), compute).count() == 3
    assert len(list((tmp_path / "cache").glob("gt.json-*"))) == 1


def test_tables_over_jdbc(spark):
    url = "jdbc:derby:memory:flows;create=true"
    spark.range(100).selectExpr("id AS K", "cast(id * 2 AS int) AS V").write.format("jdbc").option("url", url).option("dbtable", "T").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = tables.jdbc(spark, url, "T", "K", (0, 100), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("V")).first()[0] == 9900
    assert tables.jdbc(spark, url, "(SELECT * FROM T WHERE K < 3) AS few", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 3


# products of blocks


def vectors(n=70, dim=5):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(n, dim)), 1)
    return [(int(i), None if i % 9 == 4 else int(i % 4), [float(a) for a in x[i]]) for i in rng.permutation(n)], x


def test_evaluation_by_blocks_equals_evaluation_of_pairs(spark):
    rows, x = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = {i: y for i, y, _ in rows}
    pairs = [(i, j, round(float(u[i] @ u[j]), 4) + 0.0, int(label[i] is not None and label[i] == label[j])) for i, j in itertools.permutations(label, 2)]
    pairs = spark.createDataFrame(pairs, "q long, c long, sim double, y int").persist()
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    args = (df, {"v": F.col("v")}, evaluation.cosines)
    same = lambda a, b: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect()} == {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect()}
    for size in (16, 1000):
        top = evaluation.top_ranks(*args, k=5, size=size)
        assert same(evaluation.ap_of_ranks(top, 5), evaluation.ap_at_k(pairs, 5))
        assert same(evaluation.all_ap_full(*args, size=size), evaluation.ap_full(pairs))
        assert same(evaluation.all_pr_points(*args, size=size), evaluation.pr_points(pairs))
        assert same(evaluation.all_mean_pr_curve(*args, size=size), evaluation.mean_pr_curve(pairs))


def test_reports_rank_as_one_list(spark):
    rng = np.random.default_rng(4)
    aps = [(int(i), float(rng.choice([0.0, 0.1234, 0.12345, 0.5, 0.7, 1.0]))) for i in range(60)]
    got = {r["q"]: (r["side"], r["rank"]) for r in evaluation.report(spark.createDataFrame(aps, "q long, ap double"), spark.range(70).withColumnRenamed("id", "q")).collect()}
    every = {q: 0.0 for q in range(70)} | dict(aps)
    up = sorted(every, key=lambda q: (every[q], q))
    for n, q in enumerate(up, 1):
        assert got[q] == (("worst", n) if every[q] < 0.5 else ("best", 71 - n))


def test_weight_trials_equal_the_pair_table(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, None if i % 7 == 0 else float(rng.random()), [float(a) for a in rng.normal(size=4)] if i % 8 else None, str(rng.choice(["Car", "car", "", "Tree"])), [str(e) for e in rng.choice(list("abcAB"), 3)] if i % 5 else None, [float(a) for a in rng.random(3) * 200] if i % 6 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, brightness double, hog array<float>, category string, entities array<string>, color array<float>")
    features = {"brightness": ("brightness", "scalar"), "sharp": ("brightness", "sharpness"), "hog": ("hog", "cosine"), "category": ("category", "category"), "entity": ("entities", "entity"), "color": ("color", "l2_color"), "cell": ("color", "l2_cell")}
    table = optimize.pair_table(df, df, features).persist()
    assert table.count() == 40 * 39
    vectors_ = [dict.fromkeys(features, 1.0), *[{n: 1.0} for n in features], {"hog": 0.5, "category": 0.3, "color": -1.0}]
    got = {r["trial"]: r["map"] for r in optimize.trials(df, features, vectors_, size=11).collect()}
    for t, v in enumerate(vectors_):
        used = {n: w for n, w in v.items() if w > 0}
        sim = F.round(sum((F.col(n) * w for n, w in used.items()), F.lit(0.0)), 6) + F.lit(0.0)
        want = evaluation.mean_ap(evaluation.ap_at_k(table.select("q", "c", "y", sim.alias("sim")), 5)).first()["map"]
        assert got[t] == pytest.approx(want, abs=1e-9), v


def test_weight_search_never_falls_below_equal_weights(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 4, float(rng.random()), [float(a) for a in (np.eye(4)[i % 4] + 0.4 * rng.normal(size=4))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, brightness double, hog array<float>")
    features = {"brightness": ("brightness", "scalar"), "hog": ("hog", "cosine")}
    best, base, top = optimize.optimize(df, features, n_trials=12, batch=6)
    assert top >= base and best["hog"] > best["brightness"] and sum(best.values()) == pytest.approx(1.0)
    again = optimize.optimize(df, features, n_trials=12, batch=6)
    assert again == (best, base, top)
    assert optimize.mean_ap(df, features, best).first()["map"] == pytest.approx(top)


def test_hill_climb_equals_a_plain_one(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i:03d}", float(rng.random()), [f"f{int(x)}" for x in rng.integers(0, 60, 5)], [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    rows = [(k, s, images_, [float(x / np.linalg.norm(v)) for x in v]) for k, s, images_, v in rows]
    cands = spark.createDataFrame(rows, "cluster_key string, score double, images array<string>, q_vec array<double>")
    n, swaps = 6, 120
    keys, start, end = groundtruth.diverse(cands, n=n, per_cluster=5, swaps=swaps)
    by = {r[0]: r for r in rows}

    def objective(chosen):
        sims = [float(np.dot(by[a][3], by[b][3])) for a, b in itertools.combinations(chosen, 2)]
        overlap = (n * 5 - len({x for k in chosen for x in by[k][2]})) / (n * 5)
        return 1.5 * np.mean([by[k][1] for k in chosen]) + 1 - (0.7 * np.mean(sims) + 0.3 * max(sims)) - 5 * overlap

    chosen = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:n]]
    drawn = [r["cluster_key"] for r in groundtruth.proposals(cands, swaps, 42).collect()]
    assert start == pytest.approx(objective(chosen)) and sorted(drawn) == sorted(by)  # all candidates are drawn from
    now = objective(chosen)
    for t, at in enumerate(np.random.default_rng(42).integers(0, n, swaps)):
        new = drawn[t % len(drawn)]
        if new not in chosen:
            trial = [*chosen]
            trial[at] = new
            if objective(trial) > now + 1e-12:
                chosen, now = trial, objective(trial)
    assert keys == chosen and end == pytest.approx(now) and end > start


def test_blocks_pack_every_row_once(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.array(F.col("id").cast("double"))).alias("v"))
    blocks, n = products.packed(df, {"v": F.col("v")}, 64)
    assert n == 5 and products.count_of(10) == 1 and products.count_of(2000) == 8
    import io

    seen = [dict(np.load(io.BytesIO(r["payload"]))) for r in blocks.collect()]
    assert sorted(int(i) for b in seen for i in b["id"]) == list(range(300)) and sum(int(b["v?null"].sum()) for b in seen) == 100


def test_lanczos_keeps_constants_sizes_and_smooth_images():
    flat, ramp = np.full((9, 14, 3), 77, dtype=np.uint8), np.tile(np.arange(40.0)[:, None, None], (1, 30, 3))
    assert (X.lanczos(flat, 31, 50) == 77).all() and X.lanczos(flat, 9, 14) is flat
    wave = np.sin(np.arange(64) / 5)[:, None] * np.cos(np.arange(48) / 6)[None, :]
    at = ((np.arange(192) + 0.5) / 3 - 0.5)[:, None], ((np.arange(144) + 0.5) / 3 - 0.5)[None, :]
    far = lambda resize: np.abs(resize(wave, 192, 144) - np.sin(at[0] / 5) * np.cos(at[1] / 6))[24:-24, 24:-24].max()
    assert far(X.lanczos) < 0.5 * far(X.resized)
    assert np.allclose(X.lanczos(ramp, 120, 30)[30:90, 3, 0], (np.arange(30, 90) + 0.5) / 3 - 0.5, atol=0.02)
    assert X.standardized(np.zeros((100, 100, 3), dtype=np.uint8), 18, 32).shape == (18, 32, 3)
