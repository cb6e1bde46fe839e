"""The log of changes of a cache, tables that are looked up by key, and copies of clusters."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumigrid.sources import exports, lookup
from lumigrid.sources.changelog import ChangeLog

CHANGES = "key string, seq long, value map<string,string>"


def held(log, version=None):
    return {r["key"]: r["value"] for r in log.read(version).collect()}


def change(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGES)


# log of changes


def test_fields_merge_and_later_commits_win(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/cache")
    assert held(log) == {}
    log.put(change(spark, ("a", 9, {"category": "Car", "description": "d"}), ("b", 1, {"category": "Tree"}), (None, 1, {"x": "y"})))
    first = log.put(change(spark, ("a", 1, {"category": "Boat"}), ("a", 2, {"category": "Ship", "entities": None}), ("c", 1, {"k": "v"}), ("c", 1, {"k": "v"})))
    want = {"a": {"category": "Ship", "description": "d", "entities": None}, "b": {"category": "Tree"}, "c": {"k": "v"}}
    assert held(log) == want
    log.delete(spark.createDataFrame([("a",), ("nobody",), (None,)], "key string"))
    log.put(change(spark, ("a", 0, {"category": "New"})))
    now = want | {"a": {"category": "New"}}
    assert held(log) == now and held(log, first) == want
    log.compact()
    assert held(log) == now and len(log.table.manifest().folders) == 1
    log.put(change(spark, ("b", 0, {"category": "Bush"})), ("stream", 3))
    log.put(change(spark, ("b", 0, {"category": "lost"})), ("stream", 3))  # has been committed
    assert held(log) == now | {"b": {"category": "Bush"}}
    assert [r["value"] for r in log.get("b", "nobody").collect()] == [{"category": "Bush"}]


def test_two_writers_and_a_compaction_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    ChangeLog(spark, path)
    failed = []

    def write(name):
        try:
            log = ChangeLog(spark, path)
            for i in range(4):
                log.put(change(spark, ("shared", i, {f"{name}{i}": "x"}), (f"{name}", i, {"last": str(i)})))
                if name == "b" and i == 2:
                    log.compact()
        except Exception as e:  # seen by the test
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = held(ChangeLog(spark, path))
    assert set(got["shared"]) == {f"{n}{i}" for n in "ab" for i in range(4)} and got["a"] == got["b"] == {"last": "3"}


def test_a_damaged_file_is_skipped(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/cache")
    log.put(change(spark, ("a", 1, {"x": "1"})).coalesce(1))
    folder = log.table.manifest().folders[0]
    log.put(change(spark, ("b", 1, {"x": "2"})).coalesce(1))
    for p in Path(f"{tmp_path}/cache/{folder}").glob("part-*"):
        p.write_bytes(b"not a table")
        Path(p.parent, f".{p.name}.crc").unlink(missing_ok=True)
    assert held(log) == {"b": {"x": "2"}}


# look-ups


def scanned(df):
    """Rows that the scan has given, after df has run."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            rows += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_lookups_read_few_row_groups(spark, tmp_path):
    n, group = 60_000, 2_000
    df = spark.range(n).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("file_hash"), F.concat(F.lit("img_"), "id").alias("file_name"), F.when(F.col("id") % 7 > 0, F.md5(F.lit("x"))).alias("extra"))
    path = f"{tmp_path}/table"
    lookup.clustered(df.orderBy(F.rand(3)), path, "id", ("file_hash", "file_name"), group=group, file=20_000)
    assert len(list(Path(path).glob("part-*.parquet"))) >= 2
    wanted = [r["file_hash"] for r in df.where("id in (5, 41234, 59999)").collect()]
    for column, keys, ids in (("id", [41234], {41234}), ("file_hash", wanted, {5, 41234, 59999}), ("file_name", ["img_17", "img_17", None], {17}), ("file_hash", ["absent"], set())):
        got = lookup.found(spark, path, column, keys, ["id"])
        assert {r["id"] for r in got.collect()} == ids
        assert len(ids) <= scanned(got) <= (len(ids) + 2) * group  # of thirty groups
    assert lookup.found(spark, path, "id", [None]).count() == 0 and lookup.found(spark, path, "id", []).count() == 0
    many = df.where("id % 100 = 0").select("file_hash")
    assert lookup.joined(spark, path, "file_hash", many, ["id", "file_hash"]).count() == n // 100
    with pytest.raises(ValueError):
        lookup.found(spark, path, "id", list(range(100)))


# copies


@pytest.fixture
def pictures(tmp_path):
    root = tmp_path / "uploads"
    (root / "in").mkdir(parents=True)
    for i in range(6):
        (root / "in" / f"{i}.bin").write_bytes(bytes([i]) * (1000 + i))
    return root


def test_clusters_are_copied_whole(spark, tmp_path, pictures):
    rows = [(f"cluster_{i % 2}", f"in/{i}.bin", f"x/{i}.bin") for i in range(6)]
    rows += [rows[0], ("cluster_0", "in/gone.bin", "x/gone.bin"), ("cluster_2", None, "x/null.bin"), ("cluster_1", "../secret", "x/secret"), ("../up", "in/0.bin", "x/0.bin"), ("cluster_3", "in/0.bin", "x/..")]
    target = f"{tmp_path}/best"
    got = {(r["cluster_id"], r["src"]): r for r in exports.exported(spark.createDataFrame(rows, "cluster_id string, src string, dst string").repartition(3), str(pictures), target).collect()}
    assert len(got) == 11
    for i in range(6):
        r, there = got[(f"cluster_{i % 2}", f"in/{i}.bin")], Path(target, f"cluster_{i % 2}", f"{i}.bin")
        assert r["error"] is None and r["dst"] == str(there) and there.read_bytes() == (pictures / "in" / f"{i}.bin").read_bytes() and r["bytes"] == 1000 + i
    assert all(got[k]["error"] and got[k]["dst"] is None for k in [("cluster_0", "in/gone.bin"), ("cluster_2", None), ("cluster_1", "../secret"), ("../up", "in/0.bin"), ("cluster_3", "in/0.bin")])
    assert sorted(p.name for p in Path(target).iterdir()) == ["_staged", "cluster_0", "cluster_1"] and not Path(tmp_path, "up").exists()
    again = exports.exported(spark.createDataFrame(rows[:1], "cluster_id string, src string, dst string"), str(pictures), target).first()
    assert "already" in again["error"] and len(list(Path(target, "cluster_0").iterdir())) == 3


def test_steps_may_run_again_and_no_half_cluster_is_seen(spark, tmp_path, pictures):
    files = spark.createDataFrame([("c", f"in/{i}.bin", f"{i}.bin") for i in range(6)], "cluster_id string, src string, name string")
    base, target = f"{tmp_path}/t/_staged/run", f"{tmp_path}/t"
    copies = spark.createDataFrame(exports.copied(files, str(pictures), f"{base}/files").collect(), exports.COPIED)
    exports.placed(copies.limit(3), f"{base}/ready").collect()  # a task that was lost half-way
    assert not Path(target, "c").exists()
    assert exports.placed(copies, f"{base}/ready").count() == 6
    one = copies.select("cluster_id").distinct()
    for _ in range(2):
        assert [r["error"] for r in exports.committed(one, f"{base}/ready", target).collect()] == [None]
    assert len(list(Path(target, "c").iterdir())) == 6
    assert exports.exported(files.limit(0).withColumn("dst", F.col("name")), str(pictures), target).count() == 0
