"""Registered queries against their SQL on tables that the given ones lack: events that cleaning removes, repeated rows, ties."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import FOLDER, QUERIES, SQL, plain
from tidewheel.operators import features as X
from tidewheel.operators import importance as P
from tidewheel.operators import neighbours as N
from tidewheel.operators import series as T
from tidewheel.operators import stats as H
from tidewheel.operators import validity as V


def folder_with(path, **changed: str) -> str:
    """The small tables, some of them replaced by what SQL makes of them."""
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        name = f.removesuffix(".parquet")
        if name in changed:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{f}'")
            con.execute(f"COPY ({changed[name]}) TO '{path}/{f}'")
        else:
            os.symlink(f"{FOLDER}/{f}", f"{path}/{f}")
    return str(path)


def same(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    ours, theirs = QUERIES[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", ["entity_join", "cohort_attrition", "missing_ids", "id_overlap"])
def test_events_that_cleaning_removes_are_recorded(spark, tmp_path, name):
    # Some durations of every entity, and all of a third of them, are 0.
    events = "SELECT * REPLACE (CASE WHEN user_id % 3 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE value END AS value) FROM events"
    same(spark, folder_with(tmp_path, events=events), name)


def _three_out_of_order(spark):
    """Durations of 0.1, 0.2 and 0.3 in that order of time, the first one last: their sums by time and by arrival differ in the last bit."""
    rows = [(1, 2, 0.2, 0.2), (1, 3, 0.3, 0.3), (1, 1, 0.1, 0.1)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "entity_id int, seq int, days double, duration double").withColumn("start_ts", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_burdens_are_added_up_by_time(spark):
    assert (0.1 + 0.2) + 0.3 != (0.2 + 0.3) + 0.1
    assert [r["burden"] for r in T.unit_burden(_three_out_of_order(spark), "daily").collect()] == [0.1 + 0.2 + 0.3]


def test_features_are_added_up_by_time(spark):
    got = X.extract(_three_out_of_order(spark), ("burden", "trajectory")).first()
    assert got["total_af_minutes"] == 0.1 + 0.2 + 0.3


def test_scores_of_large_values_keep_their_digits(spark):
    rows = [("abc"[i % 3], 1e9 + i % 3 + i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    far = df.withColumn("v", F.col("v") - 1e9)
    want = P.f_scores(far, "g", ["v"]).first()["f_score"]
    assert P.f_scores(df, "g", ["v"]).first()["f_score"] == pytest.approx(want, rel=1e-6)
    assert H.anova(df, "v", "g").first()["statistic"] == pytest.approx(want, rel=1e-6)


def test_groups_of_the_same_ranks_have_no_statistic(spark):
    df = spark.range(200_006).select((F.col("id") % 2).cast("string").alias("g"), F.floor(F.col("id") / 2).cast("double").alias("v"))
    assert P.kruskal_scores(df, "g", ["v"]).first()["h"] == 0
    assert H.kruskal(df, "v", "g").first()["statistic"] == 0


def test_equal_points_are_one_row_with_a_weight(spark, monkeypatch):
    for name, value in (("TILE", 4), ("BLOCK", 8)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(1)
    x, k, w = rng.normal(size=(30, 3)), rng.integers(0, 3, 30), rng.integers(1, 6, 30)
    df = spark.createDataFrame([(i, x[i].tolist(), int(k[i]), int(w[i])) for i in range(30)], "i long, x array<double>, cluster int, weight long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r["i"], r["to"]): (r["d"], r["n"]) for r in N.sums_by_cluster(df).collect()}
    want = {(i, t): ((d[i] * w)[k == t].sum(), w[k == t].sum() - (k[i] == t)) for i in range(30) for t in range(3)}
    assert set(got) == {key for key, (_, n) in want.items() if n > 0}
    for key, (total, n) in got.items():
        assert total == pytest.approx(want[key][0]) and n == want[key][1]
    copies = df.select(F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("copy"), (F.col("i") * 10 + F.col("copy")).alias("entity_id"), "cluster", F.col("x").alias("features"))
    a = np.array([want[i, k[i]][0] / max(1, want[i, k[i]][1]) for i in range(30)])
    b = np.array([min(want[i, t][0] / want[i, t][1] for t in range(3) if t != k[i]) for i in range(30)])
    for r in V.silhouettes(copies).collect():
        i = (r["entity_id"] - 1) // 10
        assert r["silhouette"] == pytest.approx((b[i] - a[i]) / max(a[i], b[i]))
