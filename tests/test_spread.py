"""Distances by a product of matrices, and silhouettes from them."""

import numpy as np
import pytest
from tidewheel.operators import models as M
from tidewheel.operators import neighbours as N
from tidewheel.operators import validity as V


@pytest.mark.parametrize("shift", [0.0, 1e6])
@pytest.mark.parametrize("size", [1, 4, 64])
def test_spread_keeps_the_digits_of_near_rows(shift, size):
    r = np.random.default_rng(size)
    x = r.normal(size=(40, size)) + shift
    y = np.concatenate([x[:10], x[:10] + 1e-7, x[:10] + 1e-3, r.normal(size=(30, size)) + shift])
    assert N.spread(x, y) == pytest.approx(N.gaps(x, y), rel=1e-10, abs=0)
    assert N.spread(x[:3], x[:3]).diagonal().tolist() == [0, 0, 0]
    assert N.spread(x[:2], x[:0]).shape == (2, 0)


def test_silhouettes_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 16)
    monkeypatch.setattr(N, "BLOCK", 48)
    met = []
    whole = N._paired
    monkeypatch.setattr(N, "_paired", lambda both, pairs, *rest: (met.append((pairs, both.select("_a", "_b").distinct().count())), whole(both, pairs, *rest))[1])
    r = np.random.default_rng(1)
    at = r.normal(size=(200, 3)).round(2)
    at[150:] = at[:50]  # equal points, some of the same cluster
    to = r.integers(0, 5, 200)
    found = V.silhouettes(spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(to, at, strict=True))], "entity_id long, cluster int, features array<double>"))
    got = {x["entity_id"]: x["silhouette"] for x in found.collect()}
    d = N.gaps(at, at)
    for i in range(200):
        mean = [d[i, (to == k) & (np.arange(200) != i)].mean() for k in range(5)]
        a, b = mean[to[i]], min(m for k, m in enumerate(mean) if k != to[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), rel=1e-9, abs=1e-12)
    assert all(pairs == n for pairs, n in met) and met[0][0] < 64  # each pair of blocks once


def test_silhouettes_of_several_labels_at_once(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 16)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=3).round(1).tolist(), int(r.integers(0, 3)), int(r.integers(-1, 4))) for i in range(90)]
    rows += [(90 + i, *rows[i][1:]) for i in range(20)]
    points = spark.createDataFrame(rows, "entity_id long, features array<double>, a int, b int")
    got = {x["entity_id"]: x["silhouettes"] for x in V.silhouettes_by(points, ("a", "b")).collect()}
    for of, x in enumerate("ab"):
        alone = V.silhouettes(points.select("entity_id", "features", points[x].alias("cluster"))).collect()
        assert {s["entity_id"]: s["silhouette"] for s in alone} == pytest.approx({i: v[of] for i, v in got.items()}, rel=1e-12, abs=1e-12)
    assert any(v[1] == 0 for v in got.values()) and len(got) == 110


def test_sweep_reads_vectors_and_compares_points_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            made.add(len(p))
            yield p

    rows = [(i, (r.normal(size=2) + 5 * (i % 3)).tolist()) for i in range(60)]
    vectors = M.assemble(spark.createDataFrame([(i, *x) for i, x in rows], "entity_id long, x double, y double").mapInPandas(count, "entity_id long, x double, y double"), ["x", "y"])
    compared = []
    whole = V.sums_by_cluster
    monkeypatch.setattr(V, "sums_by_cluster", lambda *a: (compared.append(a), whole(*a))[1])
    got = {x["k"]: x for x in M.sweep(vectors, range(2, 5), 2).collect()}
    assert made.value == 60 and len(compared) == 1
    assert [k for k in got if got[k]["best"]] == [3]
    fit = M.kmeans_fit(vectors, 3, 2)
    own = M._points(fit.transform(vectors))
    assert got[3]["silhouette"] == pytest.approx(V.silhouette(own).first()[0], rel=1e-9)


def test_grid_compares_points_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    vectors = M.assemble(spark.createDataFrame([(i, *(r.normal(size=2) + 5 * (i % 3)).tolist()) for i in range(60)], "entity_id long, x double, y double"), ["x", "y"])
    compared = []
    whole = V.sums_by_cluster
    monkeypatch.setattr(V, "sums_by_cluster", lambda *a: (compared.append(a), whole(*a))[1])
    got = {x["method"]: x for x in M.method_grid(vectors, [("kmeans", 3), ("gmm", 3), ("hierarchical", 2)], least_size=5).collect()}
    assert len(compared) == 1 and len(got) == 3
    assert (got["kmeans"]["n_clusters"], got["kmeans"]["min_size"], got["kmeans"]["valid_share"], got["kmeans"]["valid"]) == (3, 20, 1.0, True)
    own = M._points(M.kmeans(vectors, 3))
    assert (got["kmeans"]["silhouette"], got["kmeans"]["davies_bouldin"]) == pytest.approx((V.silhouette(own).first()[0], V.davies_bouldin(own).first()[0]), rel=1e-9)
