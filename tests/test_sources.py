"""Requests with limits, analyses that are asked once, and tables of snapshots."""

import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions.registry import image_schema
from lumigrid.operators import flows
from lumigrid.sources import asking, images, snapshots

# requests


def test_answers_keep_their_order_and_bounds():
    active, most, lock = [0], [0], threading.Lock()

    def ask(x):
        with lock:
            active[0] += 1
            most[0] = max(most[0], active[0])
        time.sleep(0.02)
        with lock:
            active[0] -= 1
        return x * 2

    got = asking.answers(ask, list(range(40)), concurrency=8)
    assert got == [(x * 2, None) for x in range(40)] and 1 < most[0] <= 8
    assert asking.answers(ask, []) == []


def test_failing_and_hanging_requests():
    calls, free = [], threading.Event()

    def ask(x):
        calls.append(x)
        if x == "hangs":
            free.wait(20)
        if x == "bad" or x == "twice" and calls.count("twice") < 2:
            raise RuntimeError("no")
        return x

    began = time.monotonic()
    got = asking.answers(ask, ["a", "hangs", "bad", "twice", "b"], concurrency=2, timeout=0.3, attempts=2)
    free.set()
    assert time.monotonic() - began < 5
    assert [x for x, _ in got] == ["a", None, None, "twice", "b"] and isinstance(got[1][1], TimeoutError) and str(got[2][1]) == "no"
    assert calls.count("bad") == 2 and calls.count("hangs") == 2 and calls.count("a") == 1


def counting(folder):
    """A provider that leaves a file for each time a name is asked; answers differ from one call to the next."""

    def analyse(names):
        out = []
        for n in names:
            Path(folder, f"{n.replace('/', '_')}-{time.time_ns()}").touch()
            if "bad" in n:
                raise RuntimeError("bad file")
            out.append({"category": f"C{n}{time.time_ns()}", "description": "d", "entities": [n]})
        return out

    return analyse


def asked(folder):
    return sorted(p.name.rsplit("-", 1)[0] for p in Path(folder).iterdir())


def test_a_hanging_file_has_an_error_and_the_others_answers(spark):
    df = spark.createDataFrame([(f"{i}",) for i in range(6)], "file_name string").coalesce(1)

    def analyse(names):
        if "3" in names:
            time.sleep(30)
        return [{"category": "C", "description": n, "entities": []} for n in names]

    got = {r["file_name"]: r for r in images.analysed(df, analyse, batch=2, timeout=0.5, attempts=1).collect()}
    assert got["3"]["category"] == "Error" and "0.5 seconds" in got["3"]["error"]
    assert all(got[str(i)]["description"] == str(i) and got[str(i)]["error"] is None for i in (0, 1, 2, 4, 5))


def embed(texts):
    return [[float(sum(map(ord, t))), 1.0] for t in texts]


def test_each_file_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    files = spark.createDataFrame([("a",), ("b",), ("x/c",), ("a",)], "file_name string")
    df = flows.semantics(files, counting(calls), embed)
    rows = {r["file_name"]: r for r in df.collect()}
    again = {r["file_name"]: r for r in df.collect()}  # a result that is read twice asks nobody
    assert rows == again and asked(calls) == ["a", "b", "x_c"] and len(rows) == 3
    # the stored embedding is that of the stored description
    from lumigrid.functions import names

    text = df.select("file_name", names.embedding_text(F.col("category"), F.col("entities"), F.col("description")).alias("t"))
    for r in text.collect():
        v = np.array(embed([r["t"]])[0])
        assert np.allclose(rows[r["file_name"]]["llm_embedding"], v / np.linalg.norm(v), atol=1e-6)


def test_cached_analyses_are_not_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = f"file://{tmp_path}/cache"
    run = lambda names: {r["file_name"]: r["category"] for r in flows.semantics(spark.createDataFrame([(n,) for n in names], "file_name string"), counting(calls), embed, cache=cache, attempts=1).collect()}
    first = run(["p/a", "b", "bad"])
    assert first["bad"] == "Error" and first["b"].startswith("Cb")
    before = asked(calls)
    second = run(["q/a", "b", "bad", "new"])
    assert second["b"] == first["b"] and second["q/a"] == first["p/a"]  # by base name
    after = asked(calls)
    assert [n for n in after if n in ("b", "p_a", "q_a")] == [n for n in before if n in ("b", "p_a")] and after.count("new") >= 1
    assert after.count("bad") > before.count("bad")  # an error is no analysis


def test_flows_ask_once(spark, tmp_path):
    from tests.test_engine import bmp

    folder, calls = tmp_path / "in", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    for i in range(3):
        (folder / f"f{i}.png").write_bytes(bmp(np.random.default_rng(i).integers(0, 255, (20, 30, 3), dtype=np.uint8)))
    none = spark.createDataFrame([], image_schema())
    new = flows.imported(spark, str(folder), none, analyse=counting(calls), embed_text=embed, features=("brightness",))
    assert new.count() == 3 and len(new.collect()) == 3 and asked(calls) == ["f0.png", "f1.png", "f2.png"]
    kept = spark.createDataFrame(new.where("file_name <> 'f2.png'").collect(), image_schema())
    after, _ = flows.synchronized(spark, str(folder), kept, lambda some: [[1.0] for _ in some], analyse=counting(calls), embed_text=embed, features=("brightness",))
    assert after.count() == 3 and asked(calls) == ["f0.png", "f1.png", "f2.png", "f2.png"]
    done = flows.completed(kept, kept.select("file_name"), counting(calls), embed, everything=True)
    assert done.count() == 2 and len(done.collect()) == 2 and len(asked(calls)) == 6
    up = flows.uploads(spark, str(folder), none, standard=(18, 32), features=("brightness",)).collect()
    assert {(r["width"], r["height"]) for r in up} == {(32, 18)} and {(r["width"], r["height"]) for r in new.collect()} == {(30, 20)}


# snapshots


ROWS = "id long, name string"


@pytest.fixture
def table(spark, tmp_path):
    t = snapshots.Snapshots(spark, f"file://{tmp_path}/table")
    assert t.create(spark.createDataFrame([], ROWS).schema) == 0
    return t


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_rollback(spark, table):
    assert rows_of(table.read()) == []
    assert table.append(spark.createDataFrame([(1, "a")], ROWS)) == 1
    old = table.read()
    assert table.append(spark.createDataFrame([(2, "b")], ROWS)) == 2
    assert table.update(lambda df: df.where("id = 2").withColumn("name", F.upper("name"))) == 3
    assert rows_of(old) == [(1, "a")] and rows_of(table.read()) == [(2, "B")] and rows_of(table.read(2)) == [(1, "a"), (2, "b")]
    assert table.rollback(2) == 4 and rows_of(table.read()) == [(1, "a"), (2, "b")]
    assert table.compact() == 5 and rows_of(table.read()) == [(1, "a"), (2, "b")] and len(table.manifest().folders) == 1
    with pytest.raises(snapshots.ConflictError):
        table.create(spark.createDataFrame([], ROWS).schema)
    table.vacuum(keep=1)
    assert table.versions() == [5] and rows_of(table.read()) == [(1, "a"), (2, "b")]


def test_concurrent_writers_lose_nothing(spark, table):
    errors = []

    def write(k):
        try:
            t = snapshots.Snapshots(spark, table.path)
            for i in range(3):
                t.append(spark.createDataFrame([(10 * k + i, f"w{k}")], ROWS).coalesce(1))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [r[0] for r in rows_of(table.read())] == [10, 11, 12, 20, 21, 22] and table.versions() == list(range(7))


def test_a_change_is_made_of_the_rows_it_replaces(spark, table):
    table.append(spark.createDataFrame([(1, "a")], ROWS))
    other, tries = snapshots.Snapshots(spark, table.path), []

    def change(df):
        tries.append(1)
        if len(tries) == 1:  # another writer commits in between
            other.append(spark.createDataFrame([(2, "b")], ROWS))
        return df.withColumn("name", F.concat("name", F.lit("!")))

    table.update(change)
    assert len(tries) == 2 and rows_of(table.read()) == [(1, "a!"), (2, "b!")]


def test_a_failed_batch_leaves_no_row(spark, table, tmp_path):
    boom = F.udf(lambda x: 1 // (x - 3), "long")
    with pytest.raises(Exception):  # noqa: B017
        table.append(spark.range(6).repartition(3).select(boom("id").alias("id"), F.lit("x").alias("name")))
    assert rows_of(table.read()) == [] and table.versions() == [0]
    assert not list((tmp_path / "table").glob("rows/*"))


def test_failed_rows_come_back(spark, table):
    new = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, None)], ROWS)
    bad = table.insert(new, {"no id": F.col("id").isNotNull(), "no name": F.col("name").isNotNull()})
    assert rows_of(table.read()) == [(1, "a")]
    assert {(r["id"], r["name"]): r["error"] for r in bad.collect()} == {(None, "b"): "no id", (3, None): "no name", (None, None): "no id; no name"}


def test_a_batch_is_committed_once(spark, table):
    for number in (0, 0, 1, 1, 0):
        table.append(spark.createDataFrame([(number, "x")], ROWS), batch=("stream", number))
    assert rows_of(table.read()) == [(0, "x"), (1, "x")]


def test_relative_names_by_any_form_of_the_folder(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name in ("x.jpg", "a b/y.PNG", "a b/z.txt"):
        (tmp_path / name).write_bytes(b"1")
    for folder in (str(tmp_path), f"{tmp_path}/", f"file:{tmp_path}", f"file://{tmp_path}"):
        assert {r["relative"] for r in images.files(spark, folder, recursive=True).collect()} == {"x.jpg", "a b/y.PNG"}
        assert {r["relative"] for r in images.files(spark, folder).collect()} == {"x.jpg"}
