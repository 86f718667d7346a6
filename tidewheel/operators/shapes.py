"""Clustering of series by shape and of points by their affinity: k-Shape, k-means under time warping, spectral clustering.

Rounds are aggregates: tasks take centres, a few arrays, as parameters, assign their series in batches and return sums by cluster.
No task sees all series of a cluster, and what reaches the driver has a size set by clusters and length of series, not by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.neighbours import indexed, neighbours
from tidewheel.operators.series import arrays
from tidewheel.operators.shared import free, save

c, lit = F.col, F.lit
SEED = 42
#: Parameter: series that are warped at once, so that a batch's cost tables stay small.
BATCH = 256


def _stacked(parts: Iterator[pd.DataFrame], column: str = "values") -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for p in parts:
        for at in range(0, len(p), BATCH):
            own = p.iloc[at : at + BATCH]
            yield own, np.array(own[column].tolist(), dtype=float)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row with mean 0 and population sd 1; a constant row is 0."""
    x = x - x.mean(axis=-1, keepdims=True)
    sd = x.std(axis=-1, keepdims=True)
    return np.where(sd > 1e-12, x / np.where(sd > 1e-12, sd, 1), 0.0)


def cross_correlation(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest normalised cross-correlation of each row with a centre over all shifts, and the shift of the row that reaches it (the first of equal ones)."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(centre, size)[None] * np.conj(np.fft.rfft(x, size, axis=1)), size, axis=1)
    ordered = np.concatenate([product[:, -(n - 1) :], product[:, :n]], axis=1) if n > 1 else product[:, :1]
    norm = np.sqrt((x * x).sum(axis=1) * (centre * centre).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(norm[:, None] > 0, ordered / norm[:, None], 0.0)
    best = np.round(ratio, 12).argmax(axis=1)
    return ratio[np.arange(len(x)), best], best - (n - 1)


def shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows moved right by so many places, zeros following in."""
    n = x.shape[1]
    at = np.arange(n)[None] - by[:, None]
    return np.where((at >= 0) & (at < n), np.take_along_axis(x, np.clip(at, 0, n - 1), axis=1), 0.0)


def shape_of(gram: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The centre that is nearest to aligned series of which ``gram`` is the sum of outer products: the first eigenvector of the centred matrix, by power iteration."""
    n = len(gram)
    centring = np.eye(n) - 1 / n
    m = centring @ gram @ centring
    v = scaled(like) if like.any() else np.linspace(-1, 1, n)
    for _ in range(500):
        new = m @ v
        size = np.sqrt(new @ new)
        if not size:
            break
        new /= size
        if abs(abs(new @ v) / max(np.sqrt(v @ v), 1e-300) - 1) < 1e-14:
            v = new
            break
        v = new
    out = scaled(v)
    return -out if out @ like < 0 else out


def kshape(series: DataFrame, k: int = 4, tries: int = 3, most: int = 30) -> tuple[DataFrame, np.ndarray, float]:
    """((entity_id, cluster, distance), centres, inertia) of long series by k-Shape.

    Series of equal length are scaled to mean 0 and sd 1; a series' distance is 1 less its greatest cross-correlation with a centre.
    A round assigns the series and adds up, for each cluster, the outer products of its series, aligned to its centre; the
    first eigenvector of that sum is the new centre.  A cluster that loses all its series keeps its centre.  Of several tries the one with
    the least sum of squared distances is taken.  Constant series have distance 1 to all centres and go to the first.
    """
    own = save(arrays(series), "series")
    length = own.select(F.size("values").alias("n")).first()
    empty = own.sparkSession.createDataFrame([], f"entity_id {own.schema['entity_id'].dataType.simpleString()}, cluster int, distance double")
    if length is None:
        return empty, np.zeros((0, 0)), 0.0
    n, best = length["n"], None

    def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [cross_correlation(x, centre) for centre in centres]
        d = np.stack([1 - r for r, _ in found], axis=1)
        label = np.round(d, 12).argmin(axis=1)
        return label, d[np.arange(len(x)), label], np.stack([s for _, s in found], axis=1)[np.arange(len(x)), label]

    def sums(centres: np.ndarray) -> Callable:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gram, cost = np.zeros((k, n, n)), np.zeros(k)
            for _, raw in _stacked(parts):
                x = scaled(raw)
                label, d, shift = assigned(x, centres)
                y = shifted(x, shift)
                for j in np.unique(label):
                    gram[j] += y[label == j].T @ y[label == j]
                    cost[j] += (d[label == j] ** 2).sum()
            yield pd.DataFrame({"cluster": np.repeat(np.arange(k), n + 1), "row": np.tile(np.arange(n + 1), k), "x": [row for j in range(k) for row in [*gram[j], np.array([cost[j]])]]})

        return run

    for t in range(tries):
        seeds = own.orderBy(F.xxhash64("entity_id", lit(SEED + t)), "entity_id").limit(k).collect()
        centres = scaled(np.array([r["values"] for r in seeds], dtype=float))
        centres = np.concatenate([centres, np.zeros((k - len(centres), n))])
        last = np.inf
        for _ in range(most):
            rows = own.mapInPandas(sums(centres), "cluster int, row int, x array<double>").select("cluster", "row", F.posexplode("x").alias("col", "x"))
            total = rows.groupBy("cluster", "row", "col").agg(F.sum("x").alias("x")).toPandas()
            gram, cost = np.zeros((k, n, n)), total.loc[total["row"] == n, "x"].sum()
            cells = total[total["row"] < n]
            gram[cells["cluster"], cells["row"], cells["col"]] = cells["x"]
            if best is None or cost < best[0] - 1e-9:
                best = (cost, centres)
            if cost >= last - 1e-9:
                break
            last = cost
            centres = np.stack([shape_of(gram[j], centres[j]) if gram[j].any() else centres[j] for j in range(k)])
    final = best[1]

    def labelled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, raw in _stacked(parts):
            label, d, _ = assigned(scaled(raw), final)
            yield pd.DataFrame({"entity_id": p["entity_id"], "cluster": label, "distance": d})

    return own.mapInPandas(labelled, empty.schema), final, float(best[0])


def _costs(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Accumulated squared costs of the best warping of every row to a centre: (rows, n + 1, m + 1)."""
    cost = (x[:, :, None] - centre[None, None]) ** 2
    rows, n, m = cost.shape
    out = np.full((rows, n + 1, m + 1), np.inf)
    out[:, 0, 0] = 0
    for i in range(n):
        for j in range(m):
            out[:, i + 1, j + 1] = cost[:, i, j] + np.minimum(np.minimum(out[:, i, j], out[:, i, j + 1]), out[:, i + 1, j])
    return out


def warped(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared warped distances, and for each row the sum and number of its values that the best path gives each place of the centre (diagonal steps first)."""
    table = _costs(x, centre)
    rows, n, m = len(x), x.shape[1], len(centre)
    total, count, each = np.zeros((rows, m)), np.zeros((rows, m)), np.arange(rows)
    i, j = np.full(rows, n), np.full(rows, m)
    open_ = np.ones(rows, dtype=bool)
    while open_.any():
        r = each[open_]
        np.add.at(total, (r, j[open_] - 1), x[r, i[open_] - 1])
        np.add.at(count, (r, j[open_] - 1), 1)
        steps = np.stack([table[each, i - 1, j - 1], table[each, i - 1, j], table[each, i, j - 1]])
        step = steps.argmin(axis=0)
        ni, nj = np.where(step == 2, i, i - 1), np.where(step == 1, j, j - 1)
        i, j = np.where(open_, ni, i), np.where(open_, nj, j)
        open_ &= (i > 0) & (j > 0)
    return table[:, n, m], total, count


def soft_warped(x: np.ndarray, centre: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft-DTW of every row to a centre with squared costs, and its gradient by the centre."""
    cost = (x[:, :, None] - centre[None, None]) ** 2
    rows, n, m = cost.shape
    table = np.full((rows, n + 2, m + 2), np.inf)
    table[:, 0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            z = -np.stack([table[:, i - 1, j - 1], table[:, i - 1, j], table[:, i, j - 1]]) / gamma
            top = z.max(axis=0)
            table[:, i, j] = cost[:, i - 1, j - 1] - gamma * (top + np.log(np.exp(z - top).sum(axis=0)))
    value = table[:, n, m].copy()
    share = np.zeros((rows, n + 2, m + 2))
    share[:, n + 1, m + 1] = 1
    table[:, :, m + 1] = table[:, n + 1, :] = -np.inf
    table[:, n + 1, m + 1] = value
    full = np.zeros((rows, n + 2, m + 2))
    full[:, 1 : n + 1, 1 : m + 1] = cost
    for i in range(n, 0, -1):
        for j in range(m, 0, -1):
            for a, b in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                share[:, i, j] += share[:, a, b] * np.exp((table[:, a, b] - table[:, i, j] - full[:, a, b]) / gamma)
    own = share[:, 1 : n + 1, 1 : m + 1]
    return value, (own * 2 * (centre[None, None] - x[:, :, None])).sum(axis=1)


def warp_kmeans(series: DataFrame, k: int = 4, metric: str = "dtw", gamma: float = 1.0, most: int = 20, rate: float = 0.1) -> tuple[DataFrame, np.ndarray, list[float]]:
    """((entity_id, cluster, cost), centres, the cost of each round) of long series by k-means under time warping.

    ``dtw``: a centre's new value at each place is the mean of the values that the best paths of its series give it, which never raises the cost.
    ``softdtw``: a step down the gradient of the soft cost; a step that raises the cost is taken back and halved.  Series have one length.
    The first centres are the series with the least hashes of their ids; a cluster without series keeps its centre.
    """
    if metric not in ("dtw", "softdtw"):
        raise ValueError(f"unknown metric {metric!r}")
    own = save(arrays(series), "series")
    kind = own.schema["entity_id"].dataType.simpleString()
    empty = own.sparkSession.createDataFrame([], f"entity_id {kind}, cluster int, cost double")
    seeds = own.orderBy(F.xxhash64("entity_id", lit(SEED)), "entity_id").limit(k).collect()
    if not seeds:
        return empty, np.zeros((0, 0)), []
    centres = np.array([r["values"] for r in seeds], dtype=float)
    m = centres.shape[1]

    def measured(x: np.ndarray, at: np.ndarray) -> list[tuple]:
        if metric == "dtw":
            return [warped(x, centre) for centre in at]
        return [(*soft_warped(x, centre, gamma), np.ones((len(x), m))) for centre in at]

    def sums(at: np.ndarray) -> Callable:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count, cost, size = np.zeros(at.shape), np.zeros(at.shape), np.zeros(len(at)), np.zeros(len(at))
            for _, x in _stacked(parts):
                found = measured(x, at)
                label = np.stack([f[0] for f in found]).argmin(axis=0)
                for j in np.unique(label):
                    mine = label == j
                    for box, part in zip((cost, total, count), found[j], strict=True):
                        box[j] += part[mine].sum(axis=0)
                    size[j] += mine.sum()
            yield pd.DataFrame({"cluster": np.arange(len(at)), "x": [np.concatenate([total[j], count[j], [cost[j], size[j]]]) for j in range(len(at))]})

        return run

    def round_(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        rows = own.mapInPandas(sums(at), "cluster int, x array<double>").select("cluster", F.posexplode("x").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros((len(at), 2 * m + 2))
        flat[rows["cluster"], rows["pos"]] = rows["x"]
        return flat[:, :m], flat[:, m : 2 * m], float(flat[:, -2].sum()), flat[:, -1]

    total, count, cost, size = round_(centres)
    costs = [cost]
    for _ in range(most):
        if metric == "dtw":
            new = np.where(count > 0, total / np.maximum(count, 1), centres)
        else:
            new = centres - rate * np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 0.0)
        step = round_(new)
        if step[2] > cost and metric == "softdtw" and rate > 1e-6:
            rate /= 2
            continue
        if step[2] >= cost - 1e-12 * max(1.0, abs(cost)):
            break
        centres, (total, count, cost, size) = new, step
        costs.append(cost)
    final = centres

    def labelled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, x in _stacked(parts):
            d = np.stack([f[0] for f in measured(x, final)])
            yield pd.DataFrame({"entity_id": p["entity_id"], "cluster": d.argmin(axis=0), "cost": d.min(axis=0)})

    return own.mapInPandas(labelled, empty.schema), final, costs


# Spectral clustering


def affinities(points: DataFrame, near: int) -> DataFrame:
    """The saved (i, j, w), both ways: 1 for pairs that are each other's near neighbours, one half if only one is the other's; normalised by both points' sums."""
    own = neighbours(points, near).select("i", "j")
    half = own.union(own.select(c("j").alias("i"), c("i").alias("j"))).groupBy("i", "j").agg((F.count("*") / 2).alias("w"))
    # Every point also keeps to itself, which keeps the greatest eigenvalues the largest ones.
    full = half.union(points.select("i", c("i").alias("j"), lit(1.0).alias("w")))
    sums = full.groupBy("i").agg(F.sum("w").alias("s"))
    both = full.join(sums, "i").join(sums.withColumnsRenamed({"i": "j", "s": "t"}), "j")
    return save(both.select("i", "j", (c("w") / F.sqrt(c("s") * c("t"))).alias("w")), "affinities")


def eigenvectors(edges: DataFrame, k: int, rounds: int = 40, tolerance: float = 1e-7, more: int = 4) -> tuple[DataFrame, np.ndarray]:
    """((i, v array), eigenvalues): the k greatest eigenvectors of a symmetric edge table, by orthogonal subspace iteration with some ``more`` columns.

    A round is a join of edges with the vectors' rows and a sum by row; what reaches the driver are two matrices of k + more rows and columns, by
    which the columns are made orthonormal and turned to the eigenvectors within their span.
    """
    n = k + more
    now = edges.select("i").distinct().select("i", F.array(*[F.xxhash64("i", lit(SEED + j)).cast("double") / float(1 << 63) for j in range(n)]).alias("v"))
    now, held, values = save(now, "vectors"), None, np.zeros(k)

    def mixed(by: np.ndarray, columns: int):
        # An array of constants, so that rounds share their compiled code.
        turned = F.array(*[F.array(*[lit(float(by[a, b])) for a in range(n)]) for b in range(columns)])
        return F.transform(turned, lambda column: F.aggregate(F.zip_with(c("v"), column, lambda p, q: p * q), lit(0.0), lambda s, x: s + x)).alias("v")

    for t in range(rounds):
        far = edges.join(now.withColumnRenamed("i", "j"), "j").select("i", *[(c("w") * c("v")[a]).alias(f"v{a}") for a in range(n)])
        new = save(far.groupBy("i").agg(*[F.sum(f"v{a}").alias(f"v{a}") for a in range(n)]).select("i", F.array(*[f"v{a}" for a in range(n)]).alias("v")), "vectors")
        both = now.join(new.withColumnRenamed("v", "u"), "i")
        row = both.agg(*[F.sum(c("v")[a] * c(x)[b]).alias(f"{x}{a}_{b}") for x in "vu" for a in range(n) for b in range(n)]).first()
        gram, inner = (np.array([[row[f"{x}{a}_{b}"] or 0.0 for b in range(n)] for a in range(n)]) for x in "vu")
        size, turn = np.linalg.eigh((gram + gram.T) / 2)
        # Directions that are only rounding are left out.
        fix = turn * np.where(size > 1e-13 * max(size.max(), 1e-300), 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
        found, turn = np.linalg.eigh(fix.T @ (inner + inner.T) / 2 @ fix)
        order = np.argsort(-found)
        by, change, values = fix @ turn[:, order], np.abs(found[order][:k] - values).max(), found[order][:k]
        if change < tolerance or t == rounds - 1:
            out = save(now.select("i", mixed(by, k)), "eigenvectors")
            free(*[x for x in (held, new) if x is not None])
            return out, values
        if held is not None:
            free(held)
        held, now = new, new.select("i", mixed(by, n))
    raise ValueError("no round was asked for")


def spectral(points: DataFrame, k: int = 4, near: int = 10, rounds: int = 20) -> tuple[DataFrame, np.ndarray]:
    """((entity_id, cluster), eigenvalues) of (entity_id, features): k-means on the rows, scaled to length 1, of the k greatest eigenvectors of the normalised affinities of near neighbours, after so many rounds at most.

    Rows without an id or vector are left out, an id counts once, and an empty table stays empty.
    """
    from pyspark.ml.functions import array_to_vector

    from tidewheel.operators.models import kmeans

    own = indexed(points)
    if not own.limit(1).count():
        return own.select("entity_id", lit(0).alias("cluster")), np.zeros(0)
    rows, values = eigenvectors(affinities(own, near), k, rounds)
    size = F.sqrt(F.aggregate("v", lit(0.0), lambda s, x: s + x * x))
    unit = rows.select("i", F.transform("v", lambda x: F.coalesce(x / F.nullif(size, lit(0.0)), lit(0.0))).alias("v"))
    vectors = save(unit.join(own.select("i", "entity_id"), "i").select("entity_id", array_to_vector("v").alias("v")), "rows")
    return kmeans(vectors, k).select("entity_id", "cluster"), values
