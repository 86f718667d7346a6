"""Results next to half a unit of their last digit: rounded as the SQL twins round them, and not moved there by cancelled digits."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from tidewheel.operators import events as E
from tidewheel.operators import features as X
from tidewheel.queries import rounded


@pytest.mark.parametrize("digits", [3, 4, 6, 9])
def test_halves_as_in_sql(spark, digits):
    half = 10.0**-digits / 2
    values = [2918.7899999999995 / 1440, 3304.3499999999995 / 1440, *[s * k * half for k in range(1, 4001, 2) for s in (1, -1)], *[k / 1440 for k in range(0, 2000, 9)], 0.0, 1e17, -1e305, math.inf, -math.inf, math.nan, None]
    ours = dict(rounded(spark.createDataFrame(list(enumerate(values)), "entity_id int, v double"), digits=digits).collect())
    con = duckdb.connect()
    theirs = con.execute(f"SELECT i, round(v, {digits}) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS v, unnest(range(0, {len(values)})) AS i)", [values]).fetchall()
    assert len(theirs) == len(values)
    wrong = [(values[i], ours[i], v) for i, v in theirs if repr(ours[i]) != repr(v)]
    assert not wrong


def test_slope_of_near_times(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 100_000_000, 200_000_000, *[25_920_000_000_000 + k * 700_000 for k in (0, 1, 3, 4, 8)]]  # microseconds; the last ones are at day 300
    data = [(1, i, t0 + dt.timedelta(microseconds=m), 10.0 + i, t0, 600.0) for i, m in enumerate(at)]
    events = E.align(spark.createDataFrame(data, "entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz, rr double"))
    got = X.extract(events, ("trajectory",)).first()["slope_q4"]
    u = np.array(at[3:]) - at[3]
    y = np.cumsum([d[3] for d in data])[3:]
    u, y = u - u.mean(), y - y.mean()
    assert got == pytest.approx(float(u @ y / (u @ u)) * 86400e6, rel=1e-6)


def test_hours_that_cancel_out_as_in_sql(spark):
    # Each day's hour; their sines add up to nothing but rounding, whose sign makes the peak 0 or 24.
    hours = [[17, 2, 7, 22, 17, 7], [3, 4, 6, 19, 5, 21, 20, 18], [5, 19, 16, 5, 8, 19, 5, 19], [4, 4, 15, 9, 20, 20], [20, 20, 18, 15, 6, 4, 4, 9], [16, 4, 8, 18, 19, 6, 20, 5]]
    t0 = dt.datetime(2024, 1, 1)
    data = [(e, i, t0 + dt.timedelta(days=i, hours=h), 10.0, t0, 600.0) for e, own in enumerate(hours) for i, h in enumerate(own)]
    events = E.align(spark.createDataFrame(data, "entity_id long, seq long, start_ts timestamp_ntz, duration double, anchor_ts timestamp_ntz, rr double"))
    ours = dict(rounded(X.extract(events, ("temporal",)).select("entity_id", "peak_hour")).collect())
    con = duckdb.connect()
    sql = "SELECT round((degrees(atan2(avg(sin(h * pi() / 12)), avg(cos(h * pi() / 12)))) / 15 + 24) % 24, 6) + 0.0 FROM (SELECT unnest(?::INT[]) AS h)"
    assert ours == {e: con.execute(sql, [own]).fetchone()[0] for e, own in enumerate(hours)}
