"""Ranks of values that are not the same, to the last bit, when they are made again."""

import random

import pytest
from pyspark.sql import functions as F
from tidewheel import queries as Q
from tidewheel.operators import importance as P
from tidewheel.operators import models as M
from tidewheel.operators import stats as H
from tidewheel.operators import survival as K


@pytest.fixture
def unsteady(spark):
    """60 rows whose ``x`` grows with ``y`` and has other last digits each time that it is made."""
    noise = F.udf(lambda: random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    ids = spark.range(60).select(F.col("id").alias("entity_id"), F.col("id").cast("double").alias("y"), (F.col("id") % 3).alias("g"), (F.col("id") >= 30).cast("int").alias("event"))
    return ids.withColumn("x", F.col("y") + noise())


def test_spearman_keeps_all_rows(unsteady):
    r = H.outcome_correlations(unsteady, ["x"], "y", "spearman").first()
    assert r["n"] == 60 and r["r"] == pytest.approx(1)


def test_kruskal_keeps_all_rows(unsteady):
    got, want = H.kruskal(unsteady, "x", "g").first(), H.kruskal(unsteady, "y", "g").first()
    assert got["statistic"] == pytest.approx(want["statistic"]) and got["dof"] == 2


def test_auc_keeps_all_rows(unsteady):
    r = M.auc(unsteady, "event", "x").first()
    assert (r["auc"], r["n"], r["n_events"]) == (1, 60, 30)


def test_concordance_keeps_all_rows(unsteady):
    r = K.concordance_table(unsteady.select(F.col("y").alias("time"), F.lit(1).alias("event"), "x"), "x").first()
    assert (r["concordant"], r["tied"], r["pairs"]) == (0, 0, 1770)


def test_kruskal_scores_keep_all_rows(unsteady):
    got = {r["feature"]: r for r in P.kruskal_scores(unsteady.select("g", "x", "y"), "g", ["x", "y"]).collect()}
    assert got["x"]["h"] == pytest.approx(got["y"]["h"]) and got["x"]["p_value"] == pytest.approx(got["y"]["p_value"])


def test_group_table_keeps_all_rows(unsteady):
    got = {r["feature"]: r for r in P.group_table(unsteady, "g", {"x": "x", "y": "y"}).collect()}
    assert got["x"]["p_value"] == pytest.approx(got["y"]["p_value"]) and got["x"]["importance"] == pytest.approx(got["y"]["importance"], rel=1e-6)


def test_averages_go_by_key(spark, tmp_path):
    """Customers with the same prices have the same average, in whichever files and order their orders lie."""
    prices = [0.1, 0.2, 0.3, 0.7, 1e15, 0.9, 1.1]
    spark.range(40).select(F.col("id").alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit("A").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(c * 10 + k, c, "O", p) for c in range(40) for k, p in enumerate(prices)]
    random.Random(5).shuffle(rows)
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn("o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    orders.repartition(9).write.parquet(f"{tmp_path}/orders.parquet")
    total = 0.0
    for p in prices:
        total += p
    assert {r[0] for r in Q.entities(spark, str(tmp_path)).select("price_before").collect()} == {total / len(prices)}
