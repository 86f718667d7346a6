"""Shape, warping and spectral clustering against plain versions."""

import numpy as np
import pytest
from tidewheel.operators import shapes as S
from tidewheel.operators.neighbours import indexed


def series_of(spark, x):
    return spark.createDataFrame([(i, p, float(p), float(v)) for i, row in enumerate(x) for p, v in enumerate(row)], "entity_id long, pos int, time double, value double").repartition(3)


def bumps(n=60, m=40, seed=0):
    """Shifted and scaled copies of three shapes."""
    rng, t, x, which = np.random.default_rng(seed), np.arange(m), [], []
    for i in range(n):
        at, k = rng.integers(-4, 5), i % 3
        base = [np.exp(-(((t - 20 - at) / 3) ** 2)), ((t - at >= 14) & (t - at < 26)).astype(float) - 2 * np.exp(-(((t - 20 - at) / 2) ** 2)), np.sin((t - at) / 2) * np.exp(-(((t - 20 - at) / 9) ** 2))][k]
        x.append(base * rng.uniform(0.5, 3) + rng.uniform(-2, 2) + rng.normal(size=m) * 0.01)
        which.append(k)
    return np.array(x), which


def agree(labels, which):
    pairs = {(a, b) for a, b in zip(labels, which, strict=True)}
    return len(pairs) == len(set(labels)) == len(set(which))


def test_kshape_recovers_shifted_templates(spark):
    x, which = bumps()
    found, centres, cost = S.kshape(series_of(spark, x), 3, tries=4)
    rows = {r["entity_id"]: r for r in found.collect()}
    assert agree([rows[i]["cluster"] for i in range(len(x))], which)
    assert centres.shape == (3, 40) and cost == pytest.approx(sum(r["distance"] ** 2 for r in rows.values()))


@pytest.mark.parametrize("seed", range(4))
def test_cross_correlation(seed):
    rng = np.random.default_rng(seed)
    x, centre = S.scaled(rng.normal(size=(6, 9))), S.scaled(rng.normal(size=9))
    ratio, shift = S.cross_correlation(x, centre)
    for row, r, s in zip(x, ratio, shift, strict=True):
        best = max((round(float(S.shifted(row[None], np.array([k]))[0] @ centre / np.sqrt(row @ row * (centre @ centre))), 12), -k) for k in range(-8, 9))
        assert (round(float(r), 9), s) == (round(best[0], 9), -best[1])


def test_shape_is_the_first_eigenvector():
    x = S.scaled(np.random.default_rng(1).normal(size=(30, 12)) + 2 * np.sin(np.arange(12)))
    got = S.shape_of(x.T @ x, x[0])
    c = np.eye(12) - 1 / 12
    want = np.linalg.eigh(c @ (x.T @ x) @ c)[1][:, -1]
    assert abs(got @ want) == pytest.approx(np.linalg.norm(got), rel=1e-6)


def plain_warp(x, y):
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
    i, j, path = len(x), len(y), []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = [(i - 1, j - 1), (i - 1, j), (i, j - 1)][int(np.argmin([t[i - 1, j - 1], t[i - 1, j], t[i, j - 1]]))]
    return t[-1, -1], path


def test_warping_paths():
    rng = np.random.default_rng(2)
    x, centre = rng.normal(size=(8, 7)), rng.normal(size=5)
    d, total, count = S.warped(x, centre)
    for k, row in enumerate(x):
        want, path = plain_warp(row, centre)
        assert d[k] == pytest.approx(want)
        for j in range(5):
            mine = [row[i] for i, q in path if q == j]
            assert (total[k, j], count[k, j]) == (pytest.approx(sum(mine)), len(mine))


@pytest.mark.parametrize("gamma", [0.2, 1.0])
def test_soft_warping_gradient(gamma):
    rng = np.random.default_rng(3)
    x, centre = rng.normal(size=(3, 6)), rng.normal(size=5)
    value, slope = S.soft_warped(x, centre, gamma)
    assert (value <= S.warped(x, centre)[0] + 1e-9).all()
    for j in range(5):
        step = np.eye(5)[j] * 1e-6
        assert slope[:, j] == pytest.approx((S.soft_warped(x, centre + step, gamma)[0] - S.soft_warped(x, centre - step, gamma)[0]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("metric", ["dtw", "softdtw"])
def test_warp_kmeans(spark, metric):
    x, which = bumps(18, 16, 4)
    x = S.scaled(x)
    found, centres, costs = S.warp_kmeans(series_of(spark, x), 3, metric, most=4)
    rows = {r["entity_id"]: r for r in found.collect()}
    assert len(rows) == 18 and all(b < a for a, b in zip(costs[:-1], costs[1:], strict=True)) and len(costs) > 1
    assert sum(r["cost"] for r in rows.values()) == pytest.approx(costs[-1])
    if metric == "dtw":
        for i, r in rows.items():
            each = [plain_warp(x[i], centre)[0] for centre in centres]
            assert r["cluster"] == int(np.argmin(each)) and r["cost"] == pytest.approx(min(each))


def test_warp_kmeans_centres_are_means_along_paths(spark):
    x, _ = bumps(9, 12, 5)
    _, before, _ = S.warp_kmeans(series_of(spark, x), 2, most=0)
    _, after, _ = S.warp_kmeans(series_of(spark, x), 2, most=1)
    labels = [int(np.argmin([plain_warp(row, centre)[0] for centre in before])) for row in x]
    for k in range(2):
        for j in range(12):
            mine = [row[i] for row, z in zip(x, labels, strict=True) if z == k for i, q in plain_warp(row, before[k])[1] if q == j]
            assert after[k, j] == pytest.approx(np.mean(mine) if mine else before[k, j])


def rings(n=40, seed=0):
    rng = np.random.default_rng(seed)
    angle, far = np.arange(n) // 2 * 4 * np.pi / n, np.where(np.arange(n) % 2, 1.0, 40.0)  # even, so that neighbours link each ring
    return np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1) + rng.normal(size=(n, 2)) * 0.05


def test_spectral(spark):
    x = rings()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "entity_id long, features array<double>")
    found, values = S.spectral(df, 2, 4)
    labels = {r["entity_id"]: r["cluster"] for r in found.collect()}
    assert agree([labels[i] for i in range(40)], [i % 2 for i in range(40)])
    edges = S.affinities(indexed(df), 4).collect()
    w = np.zeros((40, 40))
    for i, j, v in edges:
        w[i, j] = v
    assert np.allclose(w, w.T) and values == pytest.approx(np.sort(np.linalg.eigvalsh(w))[::-1][:2], abs=1e-3)  # after 20 rounds at most


def test_eigenvectors(spark):
    x = rings(40, 2)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "entity_id long, features array<double>")
    edges = S.affinities(indexed(df), 8)
    rows, values = S.eigenvectors(edges, 3)
    v = np.array([r["v"] for r in rows.orderBy("i").collect()])
    w = np.zeros((40, 40))
    for i, j, a in edges.collect():
        w[i, j] = a
    assert v.T @ v == pytest.approx(np.eye(3), abs=1e-6) and values == pytest.approx(np.sort(np.linalg.eigvalsh(w))[::-1][:3], abs=1e-5)
    assert w @ v[:, :2] == pytest.approx(v[:, :2] * values[:2], abs=1e-3)


def test_no_series(spark):
    none = series_of(spark, np.zeros((0, 4))) if False else spark.createDataFrame([], "entity_id long, pos int, time double, value double")
    assert S.kshape(none, 2)[0].collect() == [] and S.warp_kmeans(none, 2)[0].collect() == []
    assert S.spectral(spark.createDataFrame([], "entity_id long, features array<double>"), 2)[0].collect() == []
