import datetime as dt

import pytest
from tidewheel.operators import events as E

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz, rr string"


def rows(spark, items):
    """(days, duration, rr) of one entity."""
    return spark.createDataFrame([(1, i, None if d is None else T0 + dt.timedelta(days=d), u, T0, r) for i, (d, u, r) in enumerate(items)], SCHEMA)


def test_cleaning_order_and_nulls(spark):
    df = rows(spark, [(1, -5.0, None), (1, 0.0, None), (1, 1.0, None), (1, 10081.0, None), (1, None, None), (None, 5.0, None), (1, 5.0, "199"), (1, 5.0, "200"), (1, 5.0, "2000"), (1, 5.0, "2001"), (1, 5.0, "abc")])
    got = [r["reason"] for r in E.removal_reason(df, E.CleanConfig(min_duration=2)).orderBy("seq").collect()]
    assert got == ["negative", "zero", "too_short", "too_long", None, "no_start", "rate", None, None, "rate", None]
    report = E.cleaning_report(df).first()
    assert (report["n_original"], report["n_negative"], report["n_rate"], report["n_entities_affected"]) == (11, 1, 2, 1)


def test_empty_report(spark):
    r = E.cleaning_report(rows(spark, [])).first()
    assert r["n_original"] == 0 and r["retention_pct"] == 0


def test_overlaps_look_at_the_previous_event_only(spark):
    day = 1440
    df = rows(spark, [(0, 10.0 * day, None), (1, 1.0 * day, None), (5, 1.0, None)])
    got = [r["reason"] for r in E.removal_reason(df, E.CleanConfig(max_duration=1e9, drop_overlaps=True)).orderBy("seq").collect()]
    assert got == [None, "overlap", None]


def test_alignment_edges(spark):
    df = rows(spark, [(-0.1, 5.0, None), (0, 5.0, None), (29.99, 5.0, None), (30, 5.0, None), (365, 5.0, None), (365.01, 5.0, None), (None, 5.0, None)])
    out = E.align(df).withColumn("w", E.window_label(E.F.col("days"))).orderBy("seq").collect()
    assert [r["seq"] for r in out] == [1, 2, 3, 4, 6]
    assert [r["w"] for r in out] == ["0-30d", "0-30d", "30-90d", "other", "other"]


def test_unknown_aggregation(spark):
    with pytest.raises(ValueError):
        E.daily(E.align(rows(spark, [(1, 5.0, None)])), "mode")
