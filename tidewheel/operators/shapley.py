"""Shapley values of fitted forests and linear models, for every row.

A forest is read once as a table of nodes, whose size its trees and depth bound.  For a leaf only two things
matter for each feature on its path: the share of training rows that its splits let through,
and whether a row passes them.  So a row is, for a leaf, a pattern of passed features, and the values of all patterns
are made once a task; batches of rows look them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.shared import new_path, remove

c, lit = F.col, F.lit
#: Parameter: leaves with more features on their path than this keep no table of patterns; those of a batch are computed.
WIDEST = 10


@dataclass(frozen=True)
class Leaf:
    """A leaf of a tree: each feature on its path once, with the interval low < x <= high and the share of rows that its splits let through."""

    value: float
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=int))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def passed(self, x: np.ndarray) -> np.ndarray:
        """Rows by features: which splits let a row through."""
        own = x[:, self.features]
        return ~(own <= self.low) & ((own <= self.high) | (self.high == np.inf))


@dataclass(frozen=True)
class Forest:
    """Trees as leaves; a prediction is the mean over the trees of the values of a row's leaves."""

    trees: list[list[Leaf]]

    @property
    def base(self) -> float:
        """The mean prediction over the rows that the trees were grown on, as their nodes counted them."""
        return sum(leaf.value * float(np.prod(leaf.share)) for tree in self.trees for leaf in tree) / len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(leaf.value * leaf.passed(x).all(axis=1) for tree in self.trees for leaf in tree) / len(self.trees)


def _leaves(nodes: dict[int, dict], at: int, value: Callable, paths: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
    node = nodes[at]
    if node["leftChild"] < 0:
        own = sorted(paths)
        yield Leaf(value(node), np.array(own, dtype=int), *(np.array([paths[f][i] for f in own]) for i in range(3)))
        return
    if node["split"]["numCategories"] != -1:
        raise ValueError("splits by category are not supported")
    f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    low, high, share = paths.get(f, (-np.inf, np.inf, 1.0))
    for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
        yield from _leaves(nodes, child, value, paths | {f: (*bounds, share * nodes[child]["rawCount"] / node["rawCount"])})


def forest_of(model, spark: SparkSession) -> Forest:
    """The trees of a fitted forest or tree; a leaf of a classifier is worth its share of class 1.

    The model is saved and its table of nodes read; trees and depth bound its rows.
    """
    path = new_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows if "treeID" in rows.columns else rows.select(lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    trees: dict[int, dict[int, dict]] = {}
    for r in rows.collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(True)
    remove(spark, path)
    stats = lambda n: n["impurityStats"]
    value = (lambda n: stats(n)[1] / sum(stats(n)) if len(stats(n)) == 2 else 0.0) if hasattr(model, "numClasses") else (lambda n: n["prediction"])
    if getattr(model, "numClasses", 2) > 2:
        raise ValueError("the outcome is not binary")
    return Forest([list(_leaves(nodes, 0, value, {})) for _, nodes in sorted(trees.items())])


def pattern_values(passed: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Patterns by features: Shapley values of the game that multiplies 1 or 0 for known features by shares for unknown ones."""
    m, d = passed.shape
    size = np.arange(d)
    fact = np.cumprod([1.0, *range(1, d + 1)])
    weight = fact[size] * fact[d - 1 - size] / fact[d]  # of a set of so many other features
    out = np.zeros((m, d))
    for i in range(d):
        sums = np.zeros((m, d))
        sums[:, 0] = 1
        for j in range(d):
            if j != i:  # one more feature: unknown, or known
                sums[:, 1:] = sums[:, 1:] * share[j] + sums[:, :-1] * passed[:, [j]]
                sums[:, 0] *= share[j]
        out[:, i] = (passed[:, i] - share[i]) * (sums @ weight)
    return out


class Walker:
    """Values of batches of rows; the tables of patterns are made once."""

    def __init__(self, forest: Forest, width: int) -> None:
        self.forest, self.width = forest, width
        self.tables = [[self._table(leaf) for leaf in tree] for tree in forest.trees]

    @staticmethod
    def _table(leaf: Leaf) -> np.ndarray | None:
        d = len(leaf.features)
        return None if d > WIDEST else pattern_values((np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float), leaf.share) * leaf.value

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        for tree, tables in zip(self.forest.trees, self.tables, strict=True):
            for leaf, table in zip(tree, tables, strict=True):
                d = len(leaf.features)
                if not d:
                    continue
                passed = leaf.passed(x)
                if table is not None:
                    own = table[passed @ (1 << np.arange(d))]
                else:
                    seen, which = np.unique(passed, axis=0, return_inverse=True)
                    own = (pattern_values(seen.astype(float), leaf.share) * leaf.value)[which.ravel()]
                out[:, leaf.features] += own
        return out / len(self.forest.trees)


def forest_probabilities(vectors: DataFrame, forest: Forest, keep: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """``keep`` and ``score``, the mean of the trees for column ``v``."""
    held = vectors.sparkSession.sparkContext.broadcast(forest)

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[list(keep)].assign(score=held.value.predict(np.array(p["_x"].tolist(), dtype=float)) if len(p) else np.zeros(0))

    own = vectors.select(*keep, vector_to_array("v").alias("_x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "_x")
    return own.mapInPandas(scored, f"{schema}, score double")


def forest_values(vectors: DataFrame, forest: Forest, width: int) -> DataFrame:
    """(entity_id, prediction, base, phi array): phi[i] is what feature i of column ``v`` adds; base + sum(phi) = prediction."""
    held, base = vectors.sparkSession.sparkContext.broadcast(forest), forest.base

    def walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(held.value, width)
        for p in parts:
            x = np.array(p["_x"].tolist(), dtype=float).reshape(len(p), width)
            yield pd.DataFrame({"entity_id": p["entity_id"], "prediction": walker.forest.predict(x), "base": base, "phi": list(walker.values(x))})

    own = vectors.select("entity_id", vector_to_array("v").alias("_x"))
    kind = own.schema["entity_id"].dataType.simpleString()
    return own.mapInPandas(walked, f"entity_id {kind}, prediction double, base double, phi array<double>")


def linear_values(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """(entity_id, prediction, base, phi array) of a linear model in closed form: a coefficient times the distance from the mean of all complete rows."""
    own = df.dropna(subset=list(coefficients)).select("entity_id", *[c(x).cast("double").alias(x) for x in coefficients])
    means = own.agg(*[F.avg(x).alias(x) for x in coefficients]).first()
    base = intercept + sum(b * (means[x] or 0.0) for x, b in coefficients.items())
    phi = F.array(*[lit(float(b)) * (c(x) - lit(means[x])) for x, b in coefficients.items()])
    total: Column = sum((lit(float(b)) * c(x) for x, b in coefficients.items()), lit(float(intercept)))
    return own.select("entity_id", total.alias("prediction"), lit(base).alias("base"), phi.alias("phi"))


def mean_abs(values: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean_abs_shap), largest first."""
    named = F.element_at(F.array(*[lit(x) for x in columns]), c("pos") + 1)
    long = values.select(F.posexplode("phi").alias("pos", "phi")).groupBy("pos").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    return long.select(named.alias("feature"), "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")


def dependence(values: DataFrame, columns: list[str], feature: str, df: DataFrame) -> DataFrame:
    """(entity_id, x, phi) of one feature."""
    own = values.select("entity_id", F.get("phi", lit(columns.index(feature))).alias("phi"))
    return own.join(df.select("entity_id", c(feature).cast("double").alias("x")), "entity_id").select("entity_id", "x", "phi")
