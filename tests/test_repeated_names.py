"""Queries over ids from 100,000 on, whose file names are cut to five digits and repeat, against their SQL."""

import pytest

duckdb = pytest.importorskip("duckdb")
from lumigrid.queries import catalogue  # noqa: E402

NAMES = ("cache_log", "semantics_asked", "semantics_completed", "stats_cluster_means", "stats_histogram", "stats_members", "stats_overall", "update_hash_backfill")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("repeated")
    ids = [*range(6), *range(10_000, 10_006), *range(100_000, 100_060)]
    rows = [(i, [float((i * 7 + j * j) % 23 - 11) for j in range(64)], i % 3) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{place}/embeddings.parquet")
    return str(place)


@pytest.mark.parametrize("name", NAMES)
def test_repeated_names(spark, folder, name):
    from tests.test_oracle import plain

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    ours = catalogue.queries()[name](spark, folder).select(*cols).collect()
    rows = lambda some: sorted((tuple(plain(x) for x in r) for r in some), key=repr)
    assert rows(ours) == rows(got.fetchall())


def test_every_row_has_its_class(spark, folder):
    got = catalogue.queries()["join_same_label"](spark, folder).collect()
    assert len(got) == 72 and sum(r["links"] for r in got) == 3 * 24 * 23
    assert {r["class_id"] for r in got} == {1, 2, 3}


@pytest.mark.parametrize("listed", [5, 1024])
def test_every_row_has_all_rows_of_its_label(spark, tmp_path, monkeypatch, listed):
    from lumigrid.queries import tables

    vector = [0.0] * 64
    rows = [(i, vector, None if i % 17 == 3 else i % 3 if i % 5 else 7) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(tables, "LISTED", listed)
    got = catalogue.queries()["join_same_label"](spark, str(tmp_path)).collect()
    pairs = [(r["id"], j) for r in got for j in r["others"]]
    assert sorted(pairs) == [(a + 1, b + 1) for a, _, x in rows for b, _, y in rows if x is not None and x == y and a != b]
    assert {r["id"] for r in got} == set(range(1, 301)) and max(len(r["others"]) for r in got) < 4 * listed
    if listed == 1024:
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        want = duck.execute(f"SELECT id, class_id, links, part, others FROM ({catalogue.oracle_sql()['join_same_label']})").fetchall()
        assert sorted((*r[:4], list(r[4])) for r in got) == sorted((*r[:4], list(r[4])) for r in want)


def test_entity_overlap_keeps_nothing_for_each_pair_of_rows(spark, tmp_path):
    from tests.test_oracle import plain

    rows = [(i, [float((i * 7 + j) % 23 - 11) for j in range(64)], i % 3) for i in range(320)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["set_entity_overlap"](spark, str(tmp_path))
    assert "keys=[id#" not in got._jdf.queryExecution().executedPlan().toString()  # rows aren't grouped by pairs of ids
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = duck.execute(f"SELECT i, j, shared, either FROM ({catalogue.oracle_sql()['set_entity_overlap']})").fetchall()
    assert sorted(tuple(plain(x) for x in r) for r in got.collect()) == sorted(want) and want
