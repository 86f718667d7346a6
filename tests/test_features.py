import datetime as dt
import math

import numpy as np
import pytest
from tidewheel.operators import events as E
from tidewheel.operators import features as X

T0 = dt.datetime(2024, 1, 1)


def histories(spark, per_entity):
    data = [(e, i, T0 + dt.timedelta(days=t), float(d), T0, 600.0 + i, "night 00-05:59") for e, items in per_entity.items() for i, (t, d) in enumerate(items)]
    return E.align(spark.createDataFrame(data, "entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz, rr double, day_part string"))


@pytest.fixture(scope="module")
def found(spark):
    ev = histories(
        spark,
        {
            1: [(3, 10)],
            2: [(0, 10)],
            3: [(2, 10), (2, 10)],
            4: [(1, 5), (2, 5), (10, 1), (20, 1), (30, 1), (31, 9), (33, 7), (60, 1)],
            5: [(9, 1), (10, 3)],
        },
    )
    return {r["entity_id"]: r.asDict() for r in X.extract(ev).collect()}


def test_there_are_117(found):
    assert len(X.names()) == len(set(X.names())) == 117
    assert len(found[1]) == 118


def test_single_event(found):
    f = found[1]
    assert f["n_episodes"] == 1 and f["std_episode_duration"] == 0 and f["mean_inter_episode_interval"] == 0 and f["fano_factor_weekly"] is None
    assert f["trajectory_r_squared"] == 1 and f["trajectory_slope"] == pytest.approx(10 / 3) and f["trajectory_auc_normalized"] == 0.5


def test_no_follow_up(found):
    f = found[2]
    assert f["af_burden_percent"] == 0 and f["burden_ratio_second_first"] == 1 and f["burden_q1"] is None and f["episode_rate_per_week"] == 0


def test_equal_times(found):
    f = found[3]
    assert f["trajectory_r_squared"] is None and f["trajectory_slope_pvalue"] is None and f["burstiness_index"] == 0


def test_all_in_the_second_half(found):
    assert math.isinf(found[5]["burden_ratio_second_first"])


def test_night_only(found):
    assert found[4]["day_night_ratio"] == 0 and found[4]["burden_pct_nighttime"] == 100


def test_against_numpy(found):
    t, d = np.array([1, 2, 10, 20, 30, 31, 33, 60.0]), np.array([5, 5, 1, 1, 1, 9, 7, 1.0])
    f, cum = found[4], np.cumsum(d)
    slope, icept = np.polyfit(t, cum, 1)
    assert f["trajectory_slope"] == pytest.approx(slope) and f["trajectory_intercept"] == pytest.approx(icept)
    quad = np.polyfit(t, cum, 2)
    assert f["trajectory_quadratic_coef"] == pytest.approx(quad[0]) and f["trajectory_linear_coef"] == pytest.approx(quad[1])
    rise = d[1:] / np.diff(t)
    flat = rise < np.percentile(rise, 25)
    longest = max((len(x) for x in "".join("x" if v else " " for v in flat).split()), default=0)
    assert f["longest_plateau_episodes"] == longest
    area = np.trapezoid(np.concatenate([[0], cum, [cum[-1]]]), np.concatenate([[0], t, [60]]))
    assert f["trajectory_auc_normalized"] == pytest.approx(area / (cum[-1] * 60))
    assert f["top3_episode_contribution_pct"] == pytest.approx(100 * 21 / 30)


def test_groups(spark):
    ev = histories(spark, {1: [(3, 10)]})
    assert X.extract(ev, ("rr",)).columns[1:] == X.names(("rr",))
    with pytest.raises(ValueError):
        X.extract(ev, ("unknown",))
    with pytest.raises(ValueError):
        X.extract(ev, ())


def test_one_exchange(spark):
    plan = X.extract(histories(spark, {1: [(3, 10)]}), ("burden", "episode"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
