"""Parzen search against plain Python and a plain local search; pruned neighbours against all pairs."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumigrid.operators import groundtruth, parzen, pivots
from lumigrid.operators import similarity as S


def plain_density(points, x, width):
    def phi(z):
        return 0.5 * (1 + math.erf(z / math.sqrt(2)))

    total = 1.0  # the flat part
    for p in points:
        d = 1.0
        for a, m in zip(x, p, strict=True):
            d *= math.exp(-0.5 * ((a - m) / width) ** 2) / (width * math.sqrt(2 * math.pi)) / (phi((1 - m) / width) - phi(-m / width))
        total += d
    return math.log(total / (len(points) + 1))


def test_densities_equal_plain_python():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 40):
        points, x = rng.random((n, 3)), rng.random((20, 3))
        d = parzen.Density(points)
        assert np.allclose(d.log(x), [plain_density(points, p, d.width) for p in x])
        drawn = d.draw(rng, 500)
        assert drawn.shape == (500, 3) and (drawn >= 0).all() and (drawn <= 1).all()
    grid = (np.stack(np.meshgrid(*[np.arange(60)] * 2), -1).reshape(-1, 2) + 0.5) / 60
    assert abs(np.exp(parzen.Density(rng.random((5, 2))).log(grid)).mean() - 1) < 0.01  # a density sums to 1


def test_suggestions_equal_plain_python():
    rng = np.random.default_rng(2)
    points = rng.random((30, 2))
    scores = -((points - 0.3) ** 2).sum(1)
    got = parzen.suggested(points, scores, 3, np.random.default_rng(9))
    order = sorted(range(30), key=lambda i: (-scores[i], i))
    good, bad, twin = [points[i] for i in order[:5]], [points[i] for i in order[5:]], np.random.default_rng(9)
    for i in range(3):
        drawn = parzen.Density(np.array(good)).draw(twin, parzen.DRAWS)
        width = lambda p: max(parzen.LEAST_WIDTH, parzen.WIDTH * len(p) ** (-1 / 6))
        ratio = [plain_density(good, x, width(good)) - plain_density(bad, x, width(bad)) for x in drawn]
        assert np.array_equal(got[i], drawn[int(np.argmax(ratio))])
        bad.append(got[i])


def around_the_best(evaluate, d, n_trials, seed, batch=25):
    """Random weights first, then ones around the best so far: what the Parzen search must beat."""
    rng, best, top, done = np.random.default_rng(seed), np.full(d, 1 / d), -1.0, 0
    while done < n_trials:
        some = [] if done else [best]
        while len(some) < min(batch, n_trials - done):
            some.append(rng.random(d) if done < n_trials // 3 or rng.random() < 0.25 else np.clip(best + rng.normal(0, 0.5 / d, d), 0, 1))
        for x, score in zip(some, evaluate(np.array(some)), strict=True):
            if score > top:
                best, top = x, score
        done += len(some)
    return top


@pytest.mark.parametrize("world", [0, 1])
def test_search_beats_a_local_one_over_ten_seeds(world):
    rng = np.random.default_rng(world)
    y, sims = rng.integers(0, 12, 200), []
    for noise in (0.3, 0.6, 1.0, 2.0, 9.0, 9.0):
        x = rng.normal(0, 1, (12, 4))[y] + rng.normal(0, noise, (200, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sims.append(x @ x.T)

    def evaluate(points):
        out = []
        for p in points:
            s = np.tensordot(p / p.sum(), np.array(sims), 1)
            np.fill_diagonal(s, -9)
            hits = (y[np.argsort(-s, 1, kind="stable")[:, :5]] == y[:, None]).astype(float)
            out.append(float(((np.cumsum(hits, 1) / np.arange(1, 6) * hits).sum(1) / 5).mean()))
        return out

    ours = [parzen.maximized(evaluate, np.full((1, 6), 0.5), 50, seed, 10) for seed in range(10)]
    assert all(len(p) == 50 for p, _ in ours) and np.array_equal(ours[0][0], parzen.maximized(evaluate, np.full((1, 6), 0.5), 50, 0, 10)[0])
    assert np.mean([s.max() for _, s in ours]) > np.mean([around_the_best(evaluate, 6, 50, seed) for seed in range(10)])


def clustered(n, groups, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (groups, 16))[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, 16))
    v[: n // 10] = v[0]  # a large group of copies
    v[n // 10] = 0
    return v


@pytest.mark.parametrize(("n", "groups", "size"), [(1500, 40, 64), (700, 1, 64), (300, 300, 20)])
def test_pruned_neighbours_equal_all_pairs(spark, n, groups, size, monkeypatch):
    v = clustered(n, groups)
    df = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    score = np.rint((u @ u.T) * 1e6).astype(np.int64)
    want = {(i + 1, r + 1): (int(c) + 1, score[i, c] / 1e6) for i in range(n) for r, c in enumerate(np.lexsort((np.arange(n), -score[i]))[:7])}
    met = []
    got = pivots.neighbours(df, -(-n // size), 7, size, told=met.append).collect()
    assert len(got) == n * 7 and all(want[r["q"], r["rank"]][0] == r["c"] and abs(want[r["q"], r["rank"]][1] - r["sim"]) < 1e-9 for r in got)
    if groups == 40:  # blocks are compact, so most pairs of them are never sent
        blocks = -(-n // size)
        assert met[0] < 0.35 * blocks * (blocks - 1) / 2, met
    monkeypatch.setattr(groundtruth, "PRUNED", 2)
    again = groundtruth.neighbours(df, "id", "v", 7, size).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


@pytest.mark.parametrize("crowded", [0.5, 1.0])
def test_neighbours_shuffle_no_vector(spark, crowded, monkeypatch):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(4).normal(size=(400, 16)))], "id long, v array<double>")
    monkeypatch.setattr(pivots, "CROWDED", crowded)
    got = pivots.neighbours(df, 10, 5, 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan and "Window" not in plan  # numbers of blocks meet, and k rows a query come out
    assert got.count() == 400 * 5


def test_files_of_neighbours_whose_names_repeat(spark):
    rows = [(i, f"img_{i // 2}.jpg", x.tolist()) for i, x in enumerate(np.random.default_rng(5).normal(size=(40, 4)))]
    got = groundtruth.knn_ground_truth(spark.createDataFrame(rows, "id long, file_name string, v array<double>"), "v", 3, ids=True)
    assert sorted((r["cluster_key"], r["id"], r["pos"]) for r in got.collect()) == sorted((str(i + 1), i, p) for i in range(40) for p in range(3))


def test_too_many_query_rows_are_refused(spark):
    rows = spark.range(5).select("id", F.lit("x").alias("word"))
    assert S.handful(rows, 5).count() == 5 and sorted(r["id"] for r in S.handful(rows, 5).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="more than 4 query rows"):
        S.handful(rows, 4).collect()
    assert S.handful(rows.limit(0)).collect() == []
