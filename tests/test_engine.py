"""Properties, hand cases, sources, sinks, streaming and NumPy extractors."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import extractors as X
from lumigrid.functions import names, vectors
from lumigrid.functions.registry import FEATURES, image_schema
from lumigrid.operators import catalog, groundtruth, ingest, similarity
from lumigrid.plans import weights as W
from lumigrid.sources import images, json_maps, snapshots, tables
from lumigrid.streaming import ingest as stream


def test_registry_has_31_features_and_a_schema():
    assert len(FEATURES) == 31
    assert {f.column for f in FEATURES.values()} <= set(image_schema().fieldNames())


def test_kernel_treats_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.25,)], "d double")
    assert [round(r[0], 6) for r in df.select(vectors.kernel(F.col("d"))).collect()] == [0.0, 1.0, 0.853553]


@pytest.mark.parametrize("metric", ["scalar", "sharpness", "cosine", "l2_cell", "l2_color"])
@pytest.mark.parametrize("semantics", ["online", "offline"])
def test_metrics_are_symmetric_and_bounded(spark, metric, semantics):
    rows = [(1.0, [1.0, 2.0]), (0.5, [0.0, -3.0]), (None, None), (2.0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "s double, v array<float>")
    c = "s" if metric in ("scalar", "sharpness") else "v"
    a, b = df.select(F.col(c).alias("a")), df.select(F.col(c).alias("b"))
    f = similarity.METRICS[metric]
    for x, y in a.join(b, F.lit(True)).select(f(F.col("a"), F.col("b"), semantics), f(F.col("b"), F.col("a"), semantics)).collect():
        assert x == pytest.approx(y, abs=1e-12)
        assert -1e-12 <= x <= 1 + 1e-12


def test_weights_by_mode():
    assert sum(W.resolved("equal").values()) == pytest.approx(1.0)
    assert W.resolved("optimized", stored=None) == W.resolved("equal")
    assert W.resolved("manual", {"hog": -1.0, "lbp": 0.0, "other": 2.0}) == {"hog": -1.0}
    with pytest.raises(ValueError):
        W.resolved("manual")
    assert W.limit_of(0, 7) == 7 and W.limit_of(20, 7) == 20


def test_blocked_neighbours_equal_one_block(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(60)], "id long, v array<double>")
    one = groundtruth.neighbours(df, "id", "v", 4, size=1000).orderBy("q", "rank").collect()
    many = groundtruth.neighbours(df, "id", "v", 4, size=9).orderBy("q", "rank").collect()
    assert one == many
    assert all(r["q"] == r["c"] for r in one if r["rank"] == 1)


def test_diverse_never_falls_below_its_start(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i:02}", float(rng.random()), [f"f{int(x)}" for x in rng.integers(0, 40, 5)], (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=6))) for i in range(30)]
    cands = spark.createDataFrame(rows, "cluster_key string, score double, images array<string>, q_vec array<double>")
    keys, start, end = groundtruth.diverse(cands, n=8, per_cluster=5, swaps=200)
    assert end >= start and len(set(keys)) == 8
    got = groundtruth.set_objective(cands.where(F.col("cluster_key").isin(keys)), 5).first()
    assert got["objective"] == pytest.approx(end, abs=1e-9)
    with pytest.raises(ValueError):
        groundtruth.diverse(cands, n=31, per_cluster=5)


def test_ids_continue_without_gaps(spark):
    new = spark.range(500).select(F.col("id").alias("k"))
    got = ingest.next_ids(new, spark.createDataFrame([(7,)], "id long"), "k").select("id").collect()
    assert sorted(r[0] for r in got) == list(range(8, 508))


def test_cache_merges_fields_by_latest(spark):
    a = spark.createDataFrame([("k", 1, {"x": "1", "y": "1"})], "key string, seq long, value map<string,string>")
    b = spark.createDataFrame([("k", 2, {"y": "2"})], "key string, seq long, value map<string,string>")
    assert catalog.cache_upserted(a, b).first()["value"] == {"x": "1", "y": "2"}


def test_page_buttons(spark):
    df = spark.createDataFrame([(3, 101)], "p long, n long")
    assert df.select(names.page_window(F.col("p"), F.col("n"))).first()[0] == [1, 2, 3, 4, 5]


def bmp(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    pad = -w * 3 % 4
    body = b"".join(img[y].tobytes() + bytes(pad) for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


@pytest.fixture
def folder(tmp_path):
    img = np.random.default_rng(0).integers(0, 256, (36, 64, 3), dtype=np.uint8)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.PNG").write_bytes(bmp(img))  # decoders look at the bytes, not at the name
    (tmp_path / "two.jpg").write_bytes(bmp(255 - img))
    (tmp_path / "broken.jpeg").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path, img


def test_image_files(spark, folder):
    path, _ = folder
    assert {r["file_name"] for r in images.files(spark, str(path)).collect()} == {"two.jpg", "broken.jpeg"}
    assert {r["relative"] for r in images.files(spark, str(path), recursive=True).collect()} == {"two.jpg", "broken.jpeg", "a/one.PNG"}


def test_decode_extract_and_standardize(spark, folder):
    path, img = folder
    df = images.decoded(spark, f"{path}/two.jpg")
    r = df.first()
    assert (images.array_of(r["height"], r["width"], r["channels"], bytes(r["data"])) == 255 - img).all()
    got = images.extracted(df, ("brightness", "hog"), scale=1).first()
    assert got["error"] is None and len(got["hog"]) == 1568
    assert got["brightness"][0] == pytest.approx(X.brightness(255 - img), abs=1e-6)
    s = images.standardized(df, 18, 32).first()
    assert (s["height"], s["width"]) == (18, 32)


def test_failing_provider_gives_sentinels(spark):
    df = spark.createDataFrame([("x.jpg",)], "file_name string")

    def fails(names_):
        raise RuntimeError("down")

    assert images.analysed(df, fails).first()["category"] == "Error"
    assert images.analysed(df, images.offline_provider).first()["category"] == "Unknown"


def test_extractor_dimensions():
    img = np.random.default_rng(0).integers(0, 256, (60, 100, 3), dtype=np.uint8)
    img[10:40, 20:70] = 230
    for name, f in X.EXTRACTORS.items():
        v = np.atleast_1d(f(img))
        assert len(v) == (FEATURES[name].dim or 1), name
        assert np.isfinite(v).all(), name


def test_extractors_on_simple_images():
    flat = np.full((32, 32, 3), 100, dtype=np.uint8)
    assert X.brightness(flat) == pytest.approx(100 / 255)
    assert X.contrast(flat) == 0 and X.saturation(flat) == 0 and X.edge_density(flat) == 0 and X.sharpness(flat) == 0
    assert X.soft_histogram(np.array([32.0]))[:2] == pytest.approx([0.5, 0.5], abs=1e-6)
    assert X.soft_histogram(np.array([0.0]))[0] == pytest.approx(1.0, abs=1e-6)
    box = np.zeros((50, 50, 3), dtype=np.uint8)
    box[10:30, 10:30] = 255
    g = X.geo(box)
    assert g[1] == pytest.approx(1.0) and g[3] == pytest.approx(1.0)
    assert (np.diff(X.meta_cdf_interp(box).reshape(19, 8), axis=1) >= -1e-12).all()
    assert X.regions(np.array([[1, 0, 1], [0, 1, 0]], dtype=bool), True)[1] == 1
    assert X.regions(np.array([[1, 0, 1], [0, 1, 0]], dtype=bool), False)[1] == 3


def test_json_maps(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"hog": 0.5}')
    assert json_maps.weights(spark, str(tmp_path / "w.json")) == {"hog": 0.5}
    assert json_maps.weights(spark, str(tmp_path / "none.json")) == {}
    gt = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b")], "cluster_key string, pos long, file_name string")
    json_maps.write(json_maps.to_map(gt), str(tmp_path / "gt"), as_map=("cluster_key", "files"))
    back = json_maps.clusters(json_maps.read(spark, str(tmp_path / "gt"), json_maps.GROUND_TRUTH))
    assert sorted(map(tuple, back.collect())) == [("1", 0, "a"), ("1", 1, "b")]


def test_tables_and_blobs(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    tables.append(df, path)
    tables.append(df, path)
    assert spark.read.parquet(path).count() == 2
    tables.recreate(spark, df.schema, path)
    assert spark.read.parquet(path).count() == 0
    files = spark.createDataFrame([("x/y.bin", bytearray(b"abc")), ("../out", bytearray(b"z"))], "relative string, content binary")
    got = {r["relative"]: r["error"] for r in tables.blobs(files, str(tmp_path / "b")).collect()}
    assert got["x/y.bin"] is None and got["../out"]
    assert (tmp_path / "b" / "x" / "y.bin").read_bytes() == b"abc" and not (tmp_path / "out").exists()


def test_stream_ingest_is_idempotent(spark, tmp_path):
    schema, table = "file_name string, file_hash string", f"file://{tmp_path}/table"
    spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2"), ("d", None), ("d", None)], schema).repartition(2).write.parquet(f"{tmp_path}/in")
    for name in ("c1", "c2"):  # the second run sees all files anew, and the first one's keys
        q = stream.run(stream.source(spark, f"{tmp_path}/in", schema), table, f"{tmp_path}/{name}")
        q.awaitTermination(120)
    got = snapshots.Snapshots(spark, table)
    assert sorted(map(tuple, got.read().collect())) == [("a", "1"), ("c", "2"), ("d", "d")]
    spark.createDataFrame([("e", "2"), ("f", "3")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = stream.run(stream.source(spark, f"{tmp_path}/in", schema), table, f"{tmp_path}/c1")  # goes on where it stopped
    q.awaitTermination(120)
    assert sorted(map(tuple, got.read().collect())) == [("a", "1"), ("c", "2"), ("d", "d"), ("f", "3")]


def test_a_micro_batch_reads_no_stored_row(spark, tmp_path):
    schema, table = "file_name string, file_hash string", f"file://{tmp_path}/table"
    kept = snapshots.Snapshots(spark, table)
    kept.create(spark.createDataFrame([], schema).schema)
    kept.append(spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("file_name"), F.concat(F.lit("h"), "id").alias("file_hash")))
    kept.append(spark.createDataFrame([("unhashed", None)], schema))
    source = lambda: stream.source(spark, f"{tmp_path}/in", schema, 1)
    spark.createDataFrame([("x", "h5"), ("unhashed", "new"), ("y", "fresh")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream.run(source(), table, f"{tmp_path}/c").awaitTermination(120)
    assert kept.read().count() == 20_002 and kept.read().where("file_hash = 'fresh'").count() == 1
    for i in range(2):
        spark.createDataFrame([(f"z{i}", f"z{i}"), (f"z{i}", "h7")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = stream.run(source(), table, f"{tmp_path}/c")
    q.awaitTermination(120)
    read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert kept.read().count() == 20_004 and read and max(read) <= 8, read  # its own rows, not the table's
