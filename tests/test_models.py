import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewheel.functions import special
from tidewheel.operators import models as M
from tidewheel.operators import report as R
from tidewheel.operators import series as T
from tidewheel.operators import stats as H
from tidewheel.operators import survival as K
from tidewheel.operators import validity as V


@pytest.fixture(scope="module")
def two_groups(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(y), int(i % 2)) for i, (x, y) in enumerate(rng.normal(size=(80, 2)) + 6 * (np.arange(80) % 2)[:, None])]
    return spark.createDataFrame(data, "entity_id long, x double, y double, label int").cache()


def test_tails():
    assert special.t_two_sided([2.0], [10])[0] == pytest.approx(0.0733880, abs=1e-6)
    assert special.f_tail([3.0], [2], [20])[0] == pytest.approx(0.0725382, abs=1e-6)
    assert special.chi2_tail([3.841459, 0.0], [1, 2]) == pytest.approx([0.05, 1.0], abs=1e-6)
    assert special.normal_two_sided([1.959964])[0] == pytest.approx(0.05, abs=1e-6)


def test_kmeans_finds_the_groups(two_groups):
    v = M.assemble(two_groups, ["x", "y"])
    got = M.kmeans(v, 2, 3).join(two_groups.select("entity_id", "label"), "entity_id")
    assert V.agreement(got, "cluster", "label").first()["ari"] == pytest.approx(1)
    rows = M.sweep(v, range(2, 4), 2).orderBy("k").collect()
    assert rows[0]["silhouette"] > rows[1]["silhouette"]


def test_classifiers(two_groups):
    for kind in ("logistic", "forest"):
        got = M.classify(two_groups, ["x", "y"], "label", kind)
        assert got["cv_auc"] > 0.95 and set(got["weights"]) == {"x", "y"}
    with pytest.raises(ValueError):
        M.classify(two_groups.withColumn("label", F.col("entity_id") % 3), ["x"], "label")


def test_linear(two_groups):
    got = M.linear(two_groups.withColumn("z", 2 * F.col("x") - F.col("y") + 1), ["x", "y"], "z")
    assert got["coefficients"] == pytest.approx({"x": 2, "y": -1}) and got["intercept"] == pytest.approx(1) and got["r2"] == pytest.approx(1)


def test_average_linkage():
    r = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]])
    g = M.average_linkage(r)
    assert g[0] == g[1] != g[2]


def test_yates(spark):
    data = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 20 + [("b", 0)] * 10
    got = H.chi_square(spark.createDataFrame(data, "g string, e int"), "g", "e").first()
    assert got["statistic"] == pytest.approx(60 * (300 / 1 - 30) ** 2 / 30**4, rel=1e-6) and got["dof"] == 1


def test_analysis_table(two_groups):
    df = two_groups.withColumn("sex", F.when(F.col("entity_id") < 20, 1).otherwise(2))
    rows = {r["label"]: r for r in H.analysis_table(df, {"x": "X", "sex": "Sex", "absent": "Absent"}, "label").collect()}
    assert set(rows) == {"X", "Sex"} and rows["X"]["p_value"] == "<0.001" and rows["Sex"]["overall"] == "75.0%"


def test_cox_and_log_rank(spark):
    # Two groups, known hazard ratio in the limit; compared with a direct likelihood.
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, 200)
    t = np.ceil(rng.exponential(20 / np.exp(0.7 * x)))
    e = (rng.random(200) < 0.8).astype(int)
    df = spark.createDataFrame([(int(i), float(a), int(b), int(g)) for i, (a, b, g) in enumerate(zip(t, e, x, strict=True))], "entity_id long, time double, event int, x int")
    got = K.cox(df, ["x"])
    beta = got["coefficients"]["x"]

    def efron(b):
        w, ll = np.exp(b * x), 0.0
        for at in np.unique(t[e == 1]):
            died, risk = (t == at) & (e == 1), t >= at
            d = died.sum()
            ll += b * x[died].sum() - sum(math.log(w[risk].sum() - k / d * w[died].sum()) for k in range(d))
        return ll

    grid = np.linspace(beta - 0.05, beta + 0.05, 101)
    assert abs(grid[np.argmax([efron(b) for b in grid])] - beta) < 2e-3
    assert K.log_rank(df, "x")["p_value"] < 0.05 and K.log_rank(df.withColumn("x", F.lit(0)), "x")["p_value"] == 1.0


def test_all_censored(spark):
    df = spark.createDataFrame([(i, float(i), 0, "g") for i in range(5)], "entity_id long, time double, event int, g string")
    assert {r["survival"] for r in K.kaplan_meier(df, "g").collect()} == {1.0}
    assert K.median_survival(K.kaplan_meier(df, "g"), "g").first()["median"] is None


def test_report(two_groups, tmp_path):
    r = R.Report("A & B").add("First", two_groups.limit(2)).add("None", None)
    r.save(str(tmp_path / "r.html"))
    assert "A &amp; B" in (tmp_path / "r.html").read_text() and R.embed("/nowhere.png") == ""


def test_odds_ratios(spark):
    data = [(i, "a" if i < 60 else "b", int(i % 3 == 0) if i < 60 else int(i % 2 == 0)) for i in range(120)]
    got = {r["term"]: r["odds_ratio"] for r in M.odds_ratios(spark.createDataFrame(data, "entity_id long, g string, y int"), "y", "g").collect()}
    assert got["reference"] == 1 and got["g_b"] == pytest.approx((30 / 30) / (20 / 40), rel=1e-4)


def test_dtw(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 5))
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(6) for j in range(5)], "entity_id long, pos int, value double")

    def dtw(a, b):
        d = np.full((6, 6), np.inf)
        d[0, 0] = 0
        for i in range(5):
            for j in range(5):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j + 1], d[i, j], d[i + 1, j])
        return d[5, 5]

    got = {(r["a"], r["b"]): r["distance"] for r in T.dtw_distances(df).collect()}
    assert got == pytest.approx({(i, j): dtw(x[i], x[j]) for i in range(6) for j in range(i + 1, 6)})


def _runs(spark, rows):
    """The table with a counter of how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            made.add(len(p))
            yield p

    return rows.mapInPandas(counted, rows.schema), made


def test_cox_makes_its_rows_once_and_concordance_only_if_asked(spark):
    rows = spark.createDataFrame([(float(i % 7 + 1), int(i % 3 > 0), "ab"[i % 2], float(i * i % 11)) for i in range(80)], "time double, event int, g string, x double")
    df, made = _runs(spark, rows)
    whole = K.cox_by_group(rows, "g", ["x"])
    found = K.cox_by_group(df, "g", ["x"], with_concordance=False)
    assert made.value == 80 and found["concordance"] is None and 0 < whole["concordance"] < 1
    assert found["coefficients"] == pytest.approx(whole["coefficients"])
    df, made = _runs(spark, rows)
    assert K.cox(df, ["x"])["concordance"] is not None and made.value == 80
    df, made = _runs(spark, rows)
    assert K.proportional_hazards(df, {"x": 0.1}).count() == 1 and made.value == 80
