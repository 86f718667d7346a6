"""Shapley values against all subsets, and the model path without evaluators."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from tidewheel import studies
from tidewheel.operators import models as M
from tidewheel.operators import shapley as S


def rows_of(n, d, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [round(rng.gauss(0, 1), 2) for _ in range(d)]
        out.append((i, int(x[0] + x[1] * x[2] + rng.gauss(0, 0.5) > 0), *x))
    return out


def table(spark, n=300, d=8, seed=0):
    return spark.createDataFrame(rows_of(n, d, seed), ["entity_id", "y", *[f"x{i}" for i in range(d)]])


def walk(leaves, x, known):
    """The expected value of a tree when only some features are known: other splits let their shares through."""
    return sum(leaf.value * math.prod((float(passed) if f in known else s) for f, passed, s in zip(leaf.features, leaf.passed(x[None])[0], leaf.share, strict=True)) for leaf in leaves)


@pytest.mark.parametrize("kind", ["forest", "deep tree", "regression"])
def test_forest_values_against_all_subsets(spark, kind):
    d = 8
    columns = [f"x{i}" for i in range(d)]
    data = M.assemble(table(spark, 300, d), columns, ("entity_id", "y"))
    make = {"forest": RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=5, maxDepth=4, seed=1), "deep tree": DecisionTreeRegressor(featuresCol="v", labelCol="y", maxDepth=9, seed=1), "regression": RandomForestRegressor(featuresCol="v", labelCol="y", numTrees=3, maxDepth=5, seed=1)}[kind]
    fit = make.fit(data)
    forest = S.forest_of(fit, spark)
    got = {r["entity_id"]: r for r in S.forest_values(data, forest, d).collect()}
    assert len(got) == 300
    own = {r["entity_id"]: r for r in fit.transform(data).collect()}
    for i, r in got.items():
        want = own[i]["probability"][1] if kind == "forest" else own[i]["prediction"]
        assert r["prediction"] == pytest.approx(want, abs=1e-12)
        assert r["base"] + sum(r["phi"]) == pytest.approx(r["prediction"], abs=1e-9)
    for i in (0, 7, 123):
        x = np.array(own[i]["v"].toArray())
        value = lambda known, x=x: sum(walk(t, x, known) for t in forest.trees) / len(forest.trees)
        for f in range(d):
            rest = [j for j in range(d) if j != f]
            want = sum(math.factorial(m) * math.factorial(d - 1 - m) / math.factorial(d) * (value({*s, f}) - value(set(s))) for m in range(d) for s in combinations(rest, m))
            assert got[i]["phi"][f] == pytest.approx(want, abs=1e-9)


def test_many_features_on_a_path_without_tables(spark, monkeypatch):
    columns = [f"x{i}" for i in range(8)]
    data = M.assemble(table(spark), columns, ("entity_id", "y"))
    forest = S.forest_of(RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=4, seed=1).fit(data), spark)
    x = np.array([r["v"].toArray() for r in data.collect()])
    want = S.Walker(forest, 8).values(x)
    monkeypatch.setattr(S, "WIDEST", 1)
    assert S.Walker(forest, 8).values(x) == pytest.approx(want, abs=1e-12)


def test_base_is_the_mean_of_the_grown_rows(spark):
    data = M.assemble(table(spark), ["x0", "x1"], ("entity_id", "y"))
    fit = DecisionTreeRegressor(featuresCol="v", labelCol="y", seed=1).fit(data)
    assert S.forest_of(fit, spark).base == pytest.approx(np.mean([r["y"] for r in data.collect()]), abs=1e-12)


def test_mean_abs_and_dependence(spark):
    columns = ["x0", "x1"]
    values = spark.createDataFrame([(1, [1.0, -3.0]), (2, [-2.0, 0.0])], "entity_id long, phi array<double>")
    assert [tuple(r) for r in S.mean_abs(values, columns).collect()] == [("x0", 1.5), ("x1", 1.5)]
    df = spark.createDataFrame([(1, 5.0, 6.0), (2, 7.0, 8.0)], "entity_id long, x0 double, x1 double")
    assert sorted(map(tuple, S.dependence(values, columns, "x1", df).collect())) == [(1, 6.0, -3.0), (2, 8.0, 0.0)]


def test_linear_values(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 8.0), (3, None, 1.0)], "entity_id long, a double, b double")
    got = {r["entity_id"]: r for r in S.linear_values(df, {"a": 2.0, "b": -1.0}, 10.0).collect()}
    assert got[1]["phi"] == [-2.0, 3.0] and got[2]["phi"] == [2.0, -3.0] and set(got) == {1, 2}
    assert all(r["base"] + sum(r["phi"]) == r["prediction"] for r in got.values())


def test_auc_by_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, None]), rng.choice([0.1, 0.25, 0.5, 0.75, None])) for _ in range(200)]
    seen = [(y, s) for y, s in rows if y is not None and s is not None]
    pos, neg = ([s for y, s in seen if y == v] for v in (1, 0))
    r = M.binary_report(spark.createDataFrame(rows, "y int, score double"), "y").first()
    assert r["auc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    tp, fp = sum(s > 0.5 for s in pos), sum(s > 0.5 for s in neg)
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, len(pos) - tp, len(neg) - fp)
    assert M.auc(spark.createDataFrame([(1, 0.5)], "y int, score double"), "y").first()["auc"] is None


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_scores_are_the_models_own(spark, kind):
    data = M.assemble(table(spark, 200, 3), ["x0", "x1", "x2"], ("entity_id", "y"))
    fit = (M.LogisticRegression(featuresCol="v", labelCol="y") if kind == "logistic" else RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=7, seed=1)).fit(data)
    want = {r["entity_id"]: r["probability"][1] for r in fit.transform(data).collect()}
    got = {r["entity_id"]: r["score"] for r in M.scored(fit, data, ("entity_id",)).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_forest_makes_its_rows_once(spark, monkeypatch):
    made, entities = spark.sparkContext.accumulator(0), studies.entities

    def counted(parts):
        for p in parts:
            made.add(len(p))
            yield p

    def watched(spark, sf_dir):
        e = entities(spark, sf_dir)
        return e.mapInPandas(counted, e.schema)

    monkeypatch.setattr(studies, "entities", watched)
    rows = studies.shapley_forest(spark, "/root/testdata/sf0.001").count()
    n = entities(spark, "/root/testdata/sf0.001").count()
    assert made.value == n and rows == 4 * n
