"""Percentiles, sources, importance, outcome tables, grids, concordance and reports on hand-made cases."""

import datetime as dt
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewheel.operators import events as E
from tidewheel.operators import features as X
from tidewheel.operators import importance as P
from tidewheel.operators import integration as I
from tidewheel.operators import models as M
from tidewheel.operators import outcomes as O
from tidewheel.operators import report as R
from tidewheel.operators import series as T
from tidewheel.operators import stats as H
from tidewheel.operators import survival as K
from tidewheel.operators import validity as V
from tidewheel.sources import Catalog, Source, read_csv, write_csv

T0 = dt.datetime(2024, 1, 1)


def test_quantiles_of_groups_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 9)) if rng.random() < 0.9 else None) for g in ("a", "b", None) for _ in range(60)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p"] for r in H.quantiles(df, "v", (0.0, 0.1, 0.5, 0.99, 1.0), ("g",)).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g, p in got.items():
        assert p == pytest.approx(np.percentile([v for x, v in rows if x == g and v is not None], [0, 10, 50, 99, 100]))
    assert H.quantiles(df.limit(0), "v", (0.5,), ("g",)).count() == 0


def test_average_ranks_with_weights(spark):
    rows = [(random.Random(i).randint(0, 5),) for i in range(50)]
    got = {r["v"]: (r["ties"], r["rank"]) for r in H.average_ranks(spark.createDataFrame(rows, "v int"), "v").collect()}
    values = sorted(v for v, in rows)
    assert got == {v: (values.count(v), sum(i + 1 for i, x in enumerate(values) if x == v) / values.count(v)) for v in set(values)}


def events_of(spark, rows, columns):
    return E.align(spark.createDataFrame([(1, i, T0 + dt.timedelta(days=i), 10.0 * (i + 1), T0, *r) for i, r in enumerate(rows)], f"entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz, {columns}"))


@pytest.mark.parametrize("kind, flags", [("int", [0, 1, 0, 1]), ("boolean", [False, True, False, True]), ("double", [0.0, 1.0, None, 2.0])])
def test_day_flags(spark, kind, flags):
    r = X.extract(events_of(spark, [(f,) for f in flags], f"day_part {kind}"), ("temporal",)).first()
    assert (r["n_daytime_episodes"], r["n_nighttime_episodes"], r["day_night_ratio"]) == (2, 2, 1.0)
    assert r["burden_pct_daytime"] == pytest.approx(60)


def test_rates_from_intervals(spark):
    r = X.extract(events_of(spark, [(500.0,), (1000.0,), (500.0,), (1000.0,), (0.0,)], "rr double"), ("rr",)).first()
    assert (r["mean_ventricular_rate"], r["std_ventricular_rate"], r["min_ventricular_rate"]) == (90, 30, 60)


def test_weekend_share_leaves_out_events_without_a_time(spark):
    e = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 6), 1.0, T0), (1, 2, dt.datetime(2024, 1, 8), 1.0, T0), (1, 3, None, 1.0, T0)], "entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz")
    assert X.extract(E.align(e), ("temporal",)).first()["pct_weekend_episodes"] == 50


def test_own_trajectory(spark):
    e = spark.createDataFrame([(1, 1, 2.0, 10.0), (1, 2, 4.0, 30.0), (2, 1, 0.0, 5.0)], "entity_id long, seq long, days double, duration double")
    got = {(r["entity_id"], r["pos"]): (r["time"], r["value"]) for r in T.own_trajectory(e, 5).collect()}
    assert [got[1, i] for i in range(5)] == [(0, 0), (1, 5), (2, 10), (3, 25), (4, 40)]
    assert [got[2, i] for i in range(5)] == [(0, 5)] * 5


def test_catalog(spark, tmp_path):
    df = spark.createDataFrame([("1.0", "2024-01-02 03:04:05", "7"), ("2", "no time", "x")], "id string, at string, v string")
    df.write.parquet(f"{tmp_path}/a")
    write_csv(df.select("id", "v"), f"{tmp_path}/b")
    assert read_csv(spark, f"{tmp_path}/b", "id string, v string").count() == 2
    c = Catalog(spark, {"a": Source(f"{tmp_path}/a", times=("at",), numbers=("v",), renamed={"at": "start"}, labels={"v": "a value"}), "b": Source(f"{tmp_path}/b", "csv"), "none": Source(None), "gone": Source(f"{tmp_path}/gone")})
    rows = [tuple(r) for r in c.load("a").orderBy("id").collect()]
    assert rows == [("1.0", dt.datetime(2024, 1, 2, 3, 4, 5), 7.0), ("2", None, None)]
    meta = c.metadata("a")
    assert (meta["n_rows"], meta["n_columns"], meta["labels"]) == (2, 3, {"v": "a value"}) and meta["size_mb"] > 0
    seen = {r["dataset"]: (r["n_rows"], r["n_columns"], r["error"] is None) for r in c.summary().collect()}
    assert seen == {"a": (2, 3, True), "b": (2, 2, True), "none": (None, None, False), "gone": (None, None, False)}
    assert c.load("a") is c.load("a")
    with pytest.raises(ValueError):
        c.load("none")
    c.clear()
    assert not c._held
    ids = df.select(I.normal_id(F.col("id")).alias("i"), I.normal_id(F.col("at")).alias("n")).collect()
    assert sorted(r["i"] for r in ids) == [1, 2] and {r["n"] for r in ids} == {None}


def people(spark, n=120):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        g = i % 3
        rows.append((i, g, g + rng.gauss(0, 0.5), rng.gauss(0, 1), rng.gauss(0, 1) if i % 4 else None, int(rng.random() < 0.2 + 0.3 * g), round(rng.expovariate(0.1 + 0.1 * g), 1)))
    return spark.createDataFrame(rows, "entity_id long, g int, far double, noise double, thin double, event int, time double")


def test_importance(spark):
    df = people(spark)
    found = P.discriminating(df, "g", ["far", "noise", "thin"], 2).collect()
    assert [r["feature"] for r in found][0] == "far" and len(found) == 2 and found[0]["mean_rank"] == 1
    both = P.combined(df, "g", ["far", "noise"]).collect()
    assert both[0]["feature"] == "far" and both[0]["combined_score"] == pytest.approx(1)
    gone = df.withColumn("thin", F.when(F.col("entity_id") < 30, F.col("thin")))
    assert {r["feature"] for r in P.f_scores(gone, "g", ["far", "thin"], 0.5).collect()} == {"far"}
    shown = P.importance_report({"rf": lambda: P.forest_scores(df, "g", ["far", "noise"]), "bad": lambda: P.top(df)})
    assert shown["rf"].first()["feature"] == "far" and "ValueError" in shown["bad"]
    assert P.forest_scores(df, "far", ["g", "noise"], "regression").orderBy(F.desc("importance")).first()["feature"] == "g"
    assert P.representatives([("a", 3), ("b", 2), ("c", 1), ("d", 0)], {"a": 0, "b": 0, "c": 1, "d": 2}, ["a"], 2) == ["a", "c", "d"]
    assert P.representatives([("a", 3), ("b", 2), ("c", 1)], {"a": 0, "b": 0, "c": 0}, ["a"], 1) == ["a", "b"]
    row = {r["feature"]: r for r in P.group_table(df, "g", {"far": "apart", "noise": "none"}).collect()}
    assert row["far"]["importance"] == 1 and row["far"]["p_value"] < 1e-6 and set(row["far"]["means"]) == {"0", "1", "2"}


def test_outcome_tables(spark):
    df = spark.createDataFrame([(1, "a", 1, 0, 1.0, 2.0), (2, "a", None, 1, 2.0, 1.0), (3, "b", 0, None, None, 1.0), (4, "b", 3, 1, 1.0, 4.0)], "entity_id long, g string, visits int, after int, x double, y double")
    assert {r["g"]: (r["n"], r["n_events"], r["rate_pct"]) for r in O.event_rates(df, "visits", "g").collect()} == {"a": (2, 1, 50.0), "b": (2, 1, 50.0)}
    assert {r["g"]: (r["n"], r["mean_change"], r["pct_improved"]) for r in O.change_summary(df, "x", "y", "g").collect()} == {"a": (2, 0.0, 50.0), "b": (1, 3.0, 100.0)}
    got = {(r["g"], r["overall"]): (r["before_pct"], r["after_pct"], r["change"]) for r in O.prevalences(df, {"p": ("visits", "after"), "absent": ("q", "r")}, "g").collect()}
    assert got == {(None, True): (25.0, 50.0, 25.0), ("a", False): (50.0, 50.0, 0.0), ("b", False): (0.0, 50.0, 50.0)}
    s = {r["g"]: (r["n"], r["m"]) for r in O.summary(df, [(df.select("entity_id", "y"), {"y": "m"}), (df.select("entity_id"), {"q": "z"})], "g").collect()}
    assert s == {"a": (2, 1.5), "b": (2, 2.5)}
    assert {r["entity_id"]: r["k"] for r in I.looked_up(df, "g", spark.createDataFrame([("a", 9)], "g2 string, w int"), "g2", "w", "k").collect()} == {1: 9, 2: 9, 3: None, 4: None}


def test_grid_scaler_and_stability(spark):
    rng = random.Random(2)
    rows = [(i, (i % 2) * 10 + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60)]
    v = M.assemble(spark.createDataFrame(rows, "entity_id long, x double, y double"), ["x", "y"])
    scaler = M.Scaler()
    with pytest.raises(ValueError):
        scaler.transform(v)
    z = np.array([r["v"].toArray() for r in scaler.fit(v).orderBy("entity_id").collect()])
    x = np.array([r[1:] for r in rows])
    assert np.allclose(z, (x - x.mean(axis=0)) / x.std(axis=0))
    grid = M.method_grid(v, [("kmeans", 2), ("kmeans", 30)]).collect()
    assert [(r["k"], r["valid"]) for r in grid] == [(2, True), (30, False)]
    found = M.sweep(v, range(2, 4), 2).orderBy("k").collect()
    assert found[0]["best"] and not found[1]["best"] and found[0]["ch_gain"] is None and found[1]["inertia"] < found[0]["inertia"]
    assert M.stability(v, 2, 3)["ari_mean"] == pytest.approx(1)
    report = M.cluster_report(M._points(M.kmeans(v, 2)))
    assert (report["n_clusters"], report["n_samples"], report["n_noise"]) == (2, 60, 0) and report["summary"].count() == 2
    with pytest.raises(ValueError):
        M.k_analysis(v, range(2, 3), "other")


def test_models_by_folds(spark):
    df = people(spark)
    fit = M.linear(df, ["far", "noise"], "g")
    assert fit["cv_r2"] > 0.5 and fit["cv_rmse"] >= fit["rmse"] * 0.8 and fit["n"] == 120
    c = M.classify(df, ["far", "noise"], "event")
    (tn, fp), (fn, tp) = c["confusion"]
    assert tn + fp + fn + tp == c["n"] == 120 and c["accuracy"] == (tn + tp) / 120 and 0 < c["f1"] <= 1


def test_concordance_against_all_pairs(spark):
    df = people(spark)
    rows = df.select("time", "event", "far").collect()
    right = total = 0
    for a in rows:
        for b in rows:
            if a["event"] == 1 and (a["time"] < b["time"] or (a["time"] == b["time"] and b["event"] == 0)):
                total += 1
                right += 1 if a["far"] > b["far"] else 0.5 if a["far"] == b["far"] else 0
    assert K.concordance(df, {"far": 1.0}) == pytest.approx(right / total)
    fit = K.cox(df, ["far"])
    assert fit["concordance"] == pytest.approx(right / total if fit["coefficients"]["far"] > 0 else 1 - right / total)


def test_hazards_check_against_plain_sums(spark):
    df = people(spark)
    rows = sorted((r["time"], r["event"], r["far"]) for r in df.collect())
    residuals = []
    for t, e, x in rows:
        if e:
            risk = [(math.exp(0.3 * y), y) for u, _, y in rows if u >= t]
            residuals.append((t, x - sum(w * y for w, y in risk) / sum(w for w, _ in risk)))
    times = sorted(t for t, _ in residuals)
    rank = [np.mean([i + 1 for i, u in enumerate(times) if u == t]) for t, _ in residuals]
    got = K.proportional_hazards(df, {"far": 0.3}).first()
    assert got["r"] == pytest.approx(np.corrcoef(rank, [r for _, r in residuals])[0, 1]) and got["n"] == len(residuals) and 0 <= got["p_value"] <= 1
    assert K.proportional_hazards(df.where("event = 0"), {"far": 0.3}) is None


def test_report_sections(spark, tmp_path):
    big = spark.range(1500).select(F.col("id").alias("P1"))
    tested = spark.createDataFrame([("a", 0.9), ("b", None), ("c", 0.01)], "variable string, p_value double")
    sections = [R.Section("Groups", ((None, big),)), R.Section("Features", ((None, None),)), R.before_after("Heart", tested, None, tested, "by ultrasound"), R.Section("Times", ((None, spark.range(1)),))]
    html = R.study("S", sections, footer="<end>", facts={"Entities": 1500}).render()
    assert html.count("<tr>") == 1501 + 4 + 4 + 2 and "<h2>3. Times</h2>" in html and "background" in html and "&lt;end&gt;" in html and "<b>Entities:</b> 1500" in html and "Features" not in html
    assert "<h3>2.1 Before</h3>" in html and "<h3>2.2 Change</h3>" in html and html.index("<td>c</td>") < html.index("<td>a</td>") < html.index("<td>b</td>")
    R.study("S", sections).save(str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text(encoding="utf-8") == R.study("S", sections).render()
    with pytest.raises(ValueError):
        R.study("S", sections[1:])
    assert R.display_columns(spark.createDataFrame([(1, 2)], "N int, a int")) == ["a"]


def test_cluster_summary_of_one(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 2.0]), (3, -1, [9.0, 9.0])], "entity_id long, cluster int, features array<double>")
    got = {r["cluster"]: (r["n"], r["x_mean"], r["y_std"]) for r in V.summary(p, ["x", "y"]).collect()}
    assert got == {0: (2, 2.0, 0.0), -1: (1, 9.0, None)}


def test_differences_and_dispatch(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "entity_id long") for x in ((1, 1, 2, None), (2, 3)))
    assert {tuple(r) for r in I.differences(a, b).collect()} == {(1, "right"), (3, "left")}
    e = spark.createDataFrame([(1, i, float(7 * i), 10.0) for i in range(8)], "entity_id long, seq long, days double, duration double")
    for kind, way in T.SERIES.items():
        one, two = T.dataset(e, kind, "weekly", 70), way(e, 10, 70)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    z = [r["value"] for r in T.dataset(e, "burden_rate", "weekly", 70, True).collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    with pytest.raises(ValueError):
        T.dataset(e, "other")
    assert T.state_table(e, "weekly", 70).first()["n_transitions"] >= 1


def test_feature_table(spark):
    raw = spark.createDataFrame([(1, i, T0 + dt.timedelta(days=i), d, T0) for i, d in enumerate((5.0, -1.0, 20.0, 0.0))], "entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz")
    r = X.feature_table(raw, groups=("burden",)).first()
    assert r["total_af_minutes"] == 25 and r["follow_up_days"] == 2


def once(spark, folder, n=60):
    """A table of two groups of points whose tasks leave a file each time they run."""

    def rows(parts):
        for p in parts:
            (folder / uuid.uuid4().hex).touch()
            yield p.assign(x=(p["id"] % 2) * 50.0 + p["id"] % 7, y=p["id"] % 5 * 1.0).rename(columns={"id": "entity_id"})

    return spark.range(n).coalesce(1).mapInPandas(rows, "entity_id long, x double, y double")


def test_correlations_read_their_table_once(spark, tmp_path):
    got = I.correlations(once(spark, tmp_path), ["x", "y"], 0.0).first()
    x, y = [i % 2 * 50.0 + i % 7 for i in range(60)], [i % 5 * 1.0 for i in range(60)]
    assert got["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["n"] == 60
    assert len(list(tmp_path.iterdir())) == 1


def test_stability_reads_its_vectors_once(spark, tmp_path, monkeypatch):
    drawn, fit = [], M.kmeans_fit
    monkeypatch.setattr(M, "kmeans_fit", lambda v, k, tries=10: drawn.append(sorted(r[0] for r in v.select("entity_id").collect())) or fit(v, k, tries))
    assert M.stability(M.assemble(once(spark, tmp_path), ["x", "y"]), 2, 2)["ari_mean"] == pytest.approx(1)
    hashes = [{r[0]: r[1] for r in spark.range(60).select("id", F.xxhash64("id", F.lit(M.SEED + i))).collect()} for i in range(2)]
    assert drawn[1:] == [sorted(sorted(h, key=h.get)[:48]) for h in hashes]
    assert len(list(tmp_path.iterdir())) == 1
