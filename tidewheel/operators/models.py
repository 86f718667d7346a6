"""Fitted models over feature tables: clustering, prediction, importance, reduction, with pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import validity
from tidewheel.operators.shapley import forest_of, forest_probabilities
from tidewheel.operators.shared import free, save
from tidewheel.operators.stats import average_ranks, running_counts

c, lit = F.col, F.lit
SEED = 42
#: Parameter: files of vectors that many fits read, as a small table would else be one task of each pass.
PARTS = 32


def assemble(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Complete rows with ``columns`` as one vector, ``v``."""
    own = df.dropna(subset=list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol="v").transform(own).select(*keep, "v")


def _points(labelled: DataFrame) -> DataFrame:
    return labelled.select("entity_id", "cluster", vector_to_array("v").alias("features"))


class Scaler:
    """Scales a column of vectors to mean 0 and population sd 1; fitted once, used again."""

    def __init__(self) -> None:
        self.model: StandardScalerModel | None = None
        self.n = 0

    def fit(self, vectors: DataFrame) -> DataFrame:
        self.n = vectors.count()
        self.model = StandardScaler(inputCol="v", outputCol="w", withMean=True, withStd=True).fit(vectors)
        return self.transform(vectors)

    def transform(self, vectors: DataFrame) -> DataFrame:
        """The vectors scaled as those that it was fitted on."""
        if self.model is None:
            raise ValueError("the scaler has not been fitted")
        # Spark's sd is that of a sample.
        factor = lit(math.sqrt(self.n / (self.n - 1)) if self.n > 1 else 1.0)
        scaled = F.transform(vector_to_array("w"), lambda x: x * factor)
        return self.model.transform(vectors).withColumn("v", array_to_vector(scaled)).drop("w")


def kmeans_fit(vectors: DataFrame, k: int, tries: int = 10):
    """The model with the least cost of several seeds."""
    fits = [KMeans(k=k, seed=SEED + i, featuresCol="v", predictionCol="cluster").fit(vectors) for i in range(tries)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def kmeans(vectors: DataFrame, k: int, tries: int = 10) -> DataFrame:
    """(entity_id, v, cluster) of the try with the least cost."""
    return kmeans_fit(vectors, k, tries).transform(vectors).select("entity_id", "v", "cluster")


def mixture(vectors: DataFrame, k: int) -> DataFrame:
    """(entity_id, v, cluster, probability array) of a Gaussian mixture."""
    fit = GaussianMixture(k=k, seed=SEED, featuresCol="v", predictionCol="cluster", probabilityCol="p").fit(vectors)
    return fit.transform(vectors).select("entity_id", "v", "cluster", vector_to_array("p").alias("probability"))


def bisecting(vectors: DataFrame, k: int) -> DataFrame:
    """(entity_id, v, cluster) of top-down k-means, a hierarchy that needs no distances of all pairs."""
    return BisectingKMeans(k=k, seed=SEED, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors).select("entity_id", "v", "cluster")


#: The clustering that a study settles on.
FINAL = ("kmeans", 4)
METHODS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"kmeans": kmeans, "gmm": mixture, "hierarchical": bisecting}


def sweep(vectors: DataFrame, ks: range = range(2, 10), tries: int = 10) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz, davies_bouldin, ch_gain, best) of k-means for every k; the best silhouette, of equal ones the least k."""
    vectors = save(vectors.repartition(PARTS, "entity_id"), "vectors")  # every try and pass reads them
    fits = [(k, kmeans_fit(vectors, k, tries)) for k in ks]
    # All clusterings are columns of one table, as silhouettes compare every point with all points: that is done once for all.
    names, held = [f"c{k}" for k, _ in fits], vectors
    for x, (_, fit) in zip(names, fits, strict=True):
        held = fit.transform(held).withColumnRenamed("cluster", x)
    held = save(held.select("entity_id", vector_to_array("v").alias("features"), *names), "points")
    rows = [(k, float(fit.summary.trainingCost), *m) for (k, fit), m in zip(fits, _measures_by(held, names), strict=True)]
    free(vectors, held)
    by_k = Window.orderBy("k")  # a row for each k
    out = vectors.sparkSession.createDataFrame(rows, f"k int, inertia double, {MEASURES}")
    return out.withColumns({"ch_gain": c("calinski_harabasz") - F.lag("calinski_harabasz").over(by_k), "best": F.row_number().over(Window.orderBy(F.desc("silhouette"), "k")) == 1})


MEASURES = "silhouette double, calinski_harabasz double, davies_bouldin double"


def _measures(points: DataFrame) -> tuple[float, float, float]:
    """The three measures of one clustering; its points are written once, as several jobs read them."""
    held = save(points, "points")
    out = tuple(_measured(held).first())
    free(held)
    return out


def _measures_by(points: DataFrame, names: list[str]) -> list[tuple[float, float, float]]:
    """The three measures of each clustering in a column of saved points."""
    if not names:
        return []
    seen, out = save(validity.silhouettes_by(points, tuple(names)).select(*names, "silhouettes"), "silhouettes"), []
    for of, x in enumerate(names):
        near = seen.where(c(x) != validity.NOISE).agg(F.when(F.count_distinct(x) >= 2, F.avg(F.get("silhouettes", lit(of)))).otherwise(0.0)).first()[0]
        one = points.where(c(x).isNotNull()).select("entity_id", "features", c(x).alias("cluster"))
        out.append((near, validity.calinski_harabasz(one).first()[0], validity.davies_bouldin(one).first()[0]))
    free(seen)
    return out


def _measured(points: DataFrame) -> DataFrame:
    """One row: silhouette, calinski_harabasz, davies_bouldin."""
    return validity.silhouette(points).join(F.broadcast(validity.calinski_harabasz(points))).join(F.broadcast(validity.davies_bouldin(points)))


def k_analysis(vectors: DataFrame, ks: range, method: str = "kmeans") -> DataFrame:
    """(k, silhouette, calinski_harabasz, davies_bouldin, ch_gain) of one method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = [(k, *_measures(_points(METHODS[method](vectors, k)))) for k in ks]
    return vectors.sparkSession.createDataFrame(rows, f"k int, {MEASURES}").withColumn("ch_gain", c("calinski_harabasz") - F.lag("calinski_harabasz").over(Window.orderBy("k")))


def method_grid(vectors: DataFrame, wanted: list[tuple[str, int]], least_size: int = 10, least_valid: float = 0.8) -> DataFrame:
    """(method, k, n_clusters, silhouette, calinski_harabasz, davies_bouldin, min_size, valid_share, valid), the valid ones first, by silhouette.

    Valid: no cluster smaller than ``least_size`` and enough points that are not noise.  Methods with less than ten points that are not noise are left out.
    """
    vectors = save(vectors.repartition(PARTS, "entity_id").withColumn("_row", F.monotonically_increasing_id()), "vectors")  # as in sweep
    held, names = vectors.select("_row", "entity_id", vector_to_array("v").alias("features")), [f"c{at}" for at in range(len(wanted))]
    for x, (method, k) in zip(names, wanted, strict=True):
        found = METHODS[method](vectors.select(c("_row").alias("entity_id"), "v"), k)
        held = held.join(found.select(c("entity_id").alias("_row"), c("cluster").alias(x)), "_row", "left")
    held = save(held.drop("_row"), "points")
    sizes = [{r[0]: r[1] for r in held.where(c(x).isNotNull()).groupBy(x).count().collect()} for x in names]  # a row for each cluster
    kept = [[n for x, n in own.items() if x >= 0] for own in sizes]
    large = [at for at, own in enumerate(kept) if sum(own) >= 10]
    rows = [(*wanted[at], len(kept[at]), *m, min(kept[at]), sum(kept[at]) / sum(sizes[at].values())) for at, m in zip(large, _measures_by(held, [names[at] for at in large]), strict=True)]
    free(vectors, held)
    out = vectors.sparkSession.createDataFrame(rows, f"method string, k int, n_clusters long, {MEASURES}, min_size long, valid_share double")
    return out.withColumn("valid", (c("min_size") >= least_size) & (c("valid_share") >= least_valid)).orderBy(F.desc("valid"), F.desc("silhouette"))


def cluster_report(points: DataFrame, names: list[str] | None = None, method: str = "clustering") -> dict:
    """Counts, measures, sizes, the summary of each cluster, silhouettes and representatives of (entity_id, cluster, features)."""
    first = points.select(F.size("features").alias("d")).first()
    names = names or [f"feature_{i}" for i in range(first["d"] if first else 0)]
    counts = points.agg(F.count("*").alias("n"), F.count_if(c("cluster") < 0).alias("noise"), F.count_distinct(F.when(c("cluster") >= 0, c("cluster"))).alias("k")).first()
    measures = _measured(points).first().asDict()
    return {"method": method, "n_clusters": counts["k"], "n_samples": counts["n"], "n_noise": counts["noise"], **measures, "sizes": validity.sizes(points), "summary": validity.summary(points, names), "silhouettes": validity.silhouettes(points), "representatives": validity.representatives(points)}


def gaussian_bic(vectors: DataFrame, ks: range = range(2, 9)) -> list[tuple[int, float]]:
    """(k, BIC) of Gaussian mixtures."""
    n, d = vectors.count(), len(vectors.first()["v"])
    out = []
    for k in ks:
        fit = GaussianMixture(k=k, seed=SEED, featuresCol="v").fit(vectors)
        free = k * d + k * d * (d + 1) / 2 + k - 1
        out.append((k, -2 * fit.summary.logLikelihood + free * math.log(n)))
    return out


def principal(vectors: DataFrame, k: int) -> DataFrame:
    """(entity_id, components array); signs are arbitrary."""
    return PCA(k=k, inputCol="v", outputCol="w").fit(vectors).transform(vectors).select("entity_id", vector_to_array("w").alias("components"))


def stability(vectors: DataFrame, k: int, draws: int = 100, share: float = 0.8) -> dict[str, float]:
    """Mean and sd of the agreement between clusterings of random parts and of the whole."""
    held = save(vectors.select("entity_id", "v"), "vectors")
    whole = save(kmeans(held, k).withColumnRenamed("cluster", "whole"), "whole")
    # Exactly so many rows of each draw, without replacement: those with the least hashes.  Counts by the hashes' first bits tell
    # where the last one is, so only the hashes there are ranked; a draw is then read from the one table.
    size = int(share * held.count())
    hashed = whole.select("entity_id", F.explode(F.sequence(lit(0), lit(draws - 1))).alias("draw")).select("draw", F.xxhash64("entity_id", c("draw") + SEED).alias("_h")).withColumn("_bin", F.shiftright("_h", 52))
    upto = hashed.groupBy("draw", "_bin").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.partitionBy("draw").orderBy("_bin")))
    edge = save(upto.where(c("upto") >= size).groupBy("draw").agg(F.min(F.struct("_bin", (c("upto") - c("k")).alias("below"))).alias("e")).select("draw", "e.*"), "edges")
    ranked = running_counts(hashed.join(F.broadcast(edge), ["draw", "_bin"]), "_h", ("draw",)).join(F.broadcast(edge), "draw")  # a row for each draw
    ends = {r["draw"]: r["end"] for r in ranked.groupBy("draw").agg(F.max(F.when(c("before") + c("below") < size, c("_h"))).alias("end")).collect()}
    found = []
    for i in range(draws):
        drawn = whole.where(F.xxhash64("entity_id", lit(i + SEED)) <= lit(ends[i]))
        found.append(validity.agreement(kmeans_fit(drawn, k, 1).transform(drawn), "cluster", "whole").first())
    free(held, whole, edge)
    ari, nmi = (np.array([r[x] for r in found], dtype=float) for x in ("ari", "nmi"))
    return {"ari_mean": float(ari.mean()), "ari_sd": float(ari.std()), "nmi_mean": float(nmi.mean()), "nmi_sd": float(nmi.std())}


def folds(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Add ``fold``, even within each class: rows of a class are numbered through hash partitions of it."""
    salted = df.withColumn("_s", F.pmod(F.xxhash64("entity_id", lit(SEED)), lit(64)))
    w = Window.partitionBy(label, "_s").orderBy(F.xxhash64("entity_id"), "entity_id")
    return salted.withColumn("fold", F.pmod(F.row_number().over(w) + c("_s"), lit(k)).cast("int")).drop("_s")


def _weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` that balances the classes."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) != 2:
        raise ValueError("the outcome is not binary")
    total = sum(counts.values())
    return df.withColumn("weight", reduce(lambda e, kv: e.when(c(label) == lit(kv[0]), total / (2 * kv[1])), counts.items(), F.when(lit(False), 0.0)))


def scored(fit, data: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``score``, the probability of class 1 by a fitted logistic model or forest, for column ``v``."""
    if hasattr(fit, "coefficients"):
        terms = F.zip_with(vector_to_array("v"), F.array(*[lit(float(b)) for b in fit.coefficients]), lambda x, b: x * b)
        return data.select(*keep, (1 / (1 + F.exp(-F.aggregate(terms, lit(float(fit.intercept)), lambda s, x: s + x)))).alias("score"))
    return forest_probabilities(data, forest_of(fit, data.sparkSession), keep)


def auc(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """One row: auc, n, n_events; the share of pairs of one row of each class that the score orders rightly, by the rank sum of the positives."""
    cells = scored.where(c(label).isNotNull() & c(score).isNotNull()).groupBy(score).agg(F.count("*").alias("w"), F.sum(c(label).cast("double")).alias("e"))
    cells = save(cells, "cells")  # a score made again may differ in its last bit and would find no rank
    s = cells.join(average_ranks(cells, score, (), c("w")), score).agg(F.sum(c("e") * c("rank")).alias("r"), F.sum("e").alias("p"), F.sum("w").alias("n"))
    area = (c("r") - c("p") * (c("p") + 1) / 2) / F.nullif(c("p") * (c("n") - c("p")), lit(0.0))
    return s.select(area.alias("auc"), c("n"), c("p").cast("long").alias("n_events"))


def binary_report(scored: DataFrame, label: str, score: str = "score", cut: float = 0.5) -> DataFrame:
    """One row: auc, n, n_events, tn, fp, fn, tp, accuracy, precision, recall, f1; a score above the cut is class 1."""
    is_, says = c(label) == 1, c(score) > cut
    counts = scored.where(c(label).isNotNull() & c(score).isNotNull()).agg(*[F.count_if(x).alias(n) for n, x in (("tn", ~is_ & ~says), ("fp", ~is_ & says), ("fn", is_ & ~says), ("tp", is_ & says))])
    share = lambda a, b: F.coalesce(a / F.nullif(b, lit(0)), lit(0.0))
    rates = {"accuracy": share(c("tp") + c("tn"), c("n")), "precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn")), "f1": share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))}
    return auc(scored, label, score).join(F.broadcast(counts)).withColumns(rates)  # one row each


def classify(df: DataFrame, columns: list[str], label: str, kind: str = "logistic", k: int = 5) -> dict:
    """Balanced logistic regression or random forest: AUC by stratified folds and on all rows, coefficients or importances."""
    data = folds(_weights(assemble(df, columns, ("entity_id", label)), label), label, k).persist()
    total = data.agg(F.sum("weight")).first()[0]
    make = {
        "logistic": lambda: LogisticRegression(featuresCol="v", labelCol=label, weightCol="weight", regParam=1 / total, standardization=False),
        "forest": lambda: RandomForestClassifier(featuresCol="v", labelCol=label, weightCol="weight", numTrees=100, seed=SEED),
    }[kind]
    held = ("entity_id", label)
    scores = [auc(scored(make().fit(data.where(c("fold") != i)), data.where(c("fold") == i), held), label).first()["auc"] for i in range(k)]
    fit = make().fit(data)
    weights = fit.coefficients if kind == "logistic" else fit.featureImportances
    seen = save(scored(fit, data, held), "scores")
    found = binary_report(seen, label).first()
    free(seen)
    tn, fp, fn, tp = (found[x] for x in ("tn", "fp", "fn", "tp"))
    known = [x for x in scores if x is not None]  # a fold of one class has no AUC
    n, ratio = tn + fp + fn + tp, lambda a, b: a / b if b else 0.0
    out = {
        "cv_auc": float(np.mean(known)) if known else None, "cv_auc_sd": float(np.std(known)) if known else None, "cv_auc_scores": scores, "train_auc": found["auc"], "accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "confusion": [[tn, fp], [fn, tp]], "weights": dict(zip(columns, weights.toArray().tolist(), strict=True)), "n": n, "n_events": fn + tp, "model": fit,
    }
    if kind == "logistic":
        out["intercept"] = fit.intercept
    data.unpersist()
    return out


def odds_ratios(df: DataFrame, outcome: str, group: str, covariates: list[str] = [], reference=None) -> DataFrame:  # noqa: B006
    """(term, odds_ratio, low, high, p_value) of a logistic model with the groups as 0/1 columns; the reference has 1."""
    from tidewheel.operators.survival import dummies

    wide, names = dummies(df, group, reference)
    terms = [*names, *covariates]
    fit = GeneralizedLinearRegression(family="binomial", featuresCol="v", labelCol=outcome).fit(assemble(wide, terms, ("entity_id", outcome)))
    s = fit.summary
    up = lambda v: float(np.exp(v))  # noqa: E731  infinite where a group has no such outcome
    rows = [(n, up(b), up(b - 1.96 * e), up(b + 1.96 * e), p) for n, b, e, p in zip(terms, fit.coefficients.toArray().tolist(), s.coefficientStandardErrors, s.pValues, strict=False)]
    return df.sparkSession.createDataFrame([("reference", 1.0, 1.0, 1.0, None), *rows], "term string, odds_ratio double, low double, high double, p_value double")


def linear(df: DataFrame, columns: list[str], label: str, k: int = 5) -> dict:
    """Least squares in closed form: coefficients, intercept, R2, RMSE, MAE, and R2 and RMSE by folds (the root of the mean squared error of all folds)."""
    make = lambda: LinearRegression(featuresCol="v", labelCol=label, solver="normal")
    data = folds(assemble(df.where(c(label).isNotNull()), columns, ("entity_id", label)).withColumn("_one", lit(1)), "_one", k).persist()
    fit, scores = make().fit(data), []
    for i in range(k):
        s = make().fit(data.where(c("fold") != i)).evaluate(data.where(c("fold") == i))
        scores.append((s.r2, s.meanSquaredError))
    s = fit.summary
    data.unpersist()
    return {
        "coefficients": dict(zip(columns, fit.coefficients.toArray().tolist(), strict=True)), "intercept": fit.intercept, "r2": s.r2, "mse": s.meanSquaredError, "rmse": s.rootMeanSquaredError, "mae": s.meanAbsoluteError, "n": s.numInstances,
        "cv_r2": float(np.mean([x for x, _ in scores])), "cv_r2_sd": float(np.std([x for x, _ in scores])), "cv_rmse": math.sqrt(np.mean([x for _, x in scores])),
    }


def permutation_importance(model, df: DataFrame, columns: list[str], label: str, repeats: int = 10) -> dict[str, float]:
    """Mean loss of AUC when a column is shuffled: its values are dealt again by a random order within salts."""
    own = df.dropna(subset=[*columns, label]).select("entity_id", label, *columns).persist()
    rate = lambda d: auc(scored(model, assemble(d, columns, ("entity_id", label)), ("entity_id", label)), label).first()["auc"]
    base, out = rate(own), {}
    for x in columns:
        losses = []
        for i in range(repeats):
            # Salts are dealt at random, so that shuffling inside them shuffles all.
            salted = own.withColumn("_s", F.floor(F.rand(SEED + i) * 16))
            one = Window.partitionBy("_s").orderBy("entity_id")
            two = Window.partitionBy("_s").orderBy(F.rand(SEED + 1000 + i))
            values = salted.select("_s", F.row_number().over(two).alias("_r"), c(x).alias("_x"))
            mixed = salted.withColumn("_r", F.row_number().over(one)).join(values, ["_s", "_r"]).drop(x, "_s", "_r").withColumnRenamed("_x", x)
            losses.append((base or 0.0) - (rate(mixed) or 0.0))
        out[x] = float(np.mean(losses))
    own.unpersist()
    return out


def average_linkage(correlation: np.ndarray, cut: float = 0.2) -> list[int]:
    """Clusters of features by average linkage on 1 - |r|, cut at a distance: a small matrix on the driver."""
    d = 1 - np.abs(correlation)
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])), key=lambda t: t[0])
        if best[0] > cut:
            break
        groups[best[2]] += groups.pop(best[1])
    out = [0] * len(d)
    for g, members in enumerate(groups):
        for m in members:
            out[m] = g
    return out
