"""Edge-table eigenvectors, clusters and rankings against dense solvers."""

import numpy as np
import pytest

from lagloom.operators import align as A
from lagloom.operators import cluster as C
from lagloom.operators import edges as G


def blocks(rng, sizes, inside=1.0, across=0.05):
    own = np.repeat(np.arange(len(sizes)), sizes)
    a = np.where(own[:, None] == own[None], inside, across) * rng.uniform(0.5, 1.0, (len(own), len(own)))
    a = np.triu(a, 1)
    return a + a.T, own


def pair_rows(spark, matrices, name):
    rows = [(w, int(i), int(j), float(m[i, j])) for w, m in matrices.items() for i, j in zip(*np.triu_indices(len(m), 1), strict=True)]
    return spark.createDataFrame(rows, f"w int, i long, j long, {name} double")


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_clusters_of_windows_equal_the_dense_solver(spark):
    rng = np.random.default_rng(3)
    made = {0: blocks(rng, [12, 9, 7]), 1: blocks(rng, [5, 20]), 2: blocks(rng, [1, 1])}
    pairs = pair_rows(spark, {w: a for w, (a, _) in made.items()}, "score")
    got = {}
    for r in C.spectral_clusters(pairs, [1, 2, 3], "w").collect():
        got.setdefault((r.w, r.k), {})[r.series] = r.cls
    assert set(got) == {(w, k) for w in made for k in (1, 2, 3)}
    for (w, k), own in got.items():
        labels = [own[s] for s in sorted(own)]
        assert sorted(set(labels)) == list(range(len(set(labels)))) and labels[0] == 0
        if (w, k) in ((0, 3), (1, 2), (0, 1), (2, 3)):
            assert same_partition(labels, C.spectral_labels(made[w][0], k))
    assert same_partition([got[0, 3][s] for s in range(28)], made[0][1]) and same_partition([got[1, 2][s] for s in range(25)], made[1][1])


def test_leading_vectors_equal_the_dense_solver(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    a = x @ np.diag([9, 7, 5, 1, 1, 1]) @ x.T
    edges = spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(40) for j in range(40)], "w int, i long, j long, w_ double").withColumnRenamed("w", "key").withColumnRenamed("w_", "w")
    nodes = edges.selectExpr("key", "i AS node").distinct()
    got = G.leading_vectors(nodes, lambda v, c: G.product(edges, v, c, ["key"]), 3, ["key"]).orderBy("node").collect()
    values, vectors = np.linalg.eigh(a)
    np.testing.assert_allclose(got[0].theta, values[::-1][:3], rtol=1e-9)
    mine = np.array([[r.x0, r.x1, r.x2] for r in got])
    np.testing.assert_allclose(np.abs((mine * vectors[:, ::-1][:, :3]).sum(axis=0)), 1.0, atol=1e-8)


@pytest.mark.parametrize("noise", [0.0, 1.0])
def test_ranking_equals_the_dense_one(spark, noise):
    rng = np.random.default_rng(7)
    made = {}
    for w, n in ((0, 25), (1, 40)):
        lags = rng.integers(0, 8, n)
        h = lags[:, None] - lags[None] + np.triu(np.rint(noise * rng.normal(size=(n, n))), 1)
        made[w] = np.triu(h, 1) - np.triu(h, 1).T
    made[2] = np.zeros((3, 3))
    got = {}
    for r in A.svd_lags(pair_rows(spark, made, "lag"), "w").collect():
        got.setdefault(r.w, {})[r.series] = (r.rank, r.lag)
    for w, h in made.items():
        want = A.svd_ranking(h)
        mine = np.array([got[w][s][0] for s in range(len(h))])
        np.testing.assert_allclose(mine, want, atol=1e-6)
