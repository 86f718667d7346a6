"""DuckDB SQL for the feature groups over the ``events`` table."""

WINDOWS = ((0, 7), (7, 14), (14, 21), (21, 30))

BASE = """
WITH raw AS (SELECT user_id AS entity_id, event_id AS seq, ts, value AS d, 200 + 18 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rr,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t FROM events),
e0 AS (SELECT *, 60000 / rr AS rate, CASE WHEN hour(ts) < 6 THEN 'night' ELSE 'day' END AS part FROM raw
    WHERE d > 0 AND d <= 10080 AND rr BETWEEN 200 AND 2000 AND t >= 0 AND t <= 365),
e1 AS (SELECT *, row_number() OVER o AS rn, count(*) OVER p AS n, max(t) OVER p AS last_t, sum(d) OVER p AS total,
    sum(d) OVER (PARTITION BY entity_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cum, lag(t) OVER o AS t0, avg(t) OVER p AS mean_t,
    row_number() OVER (PARTITION BY entity_id ORDER BY d DESC, t, seq) AS big,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, seq))) / 86400e6 AS gap
  FROM e0 WINDOW o AS (PARTITION BY entity_id ORDER BY t, seq), p AS (PARTITION BY entity_id)),
e AS (SELECT *, least(last_t, 365.0) AS fu, cum - d AS cum0 FROM e1)
"""


def t_two_sided(t: str, dof: str, steps: int = 400) -> str:
    """The two-sided p-value of t by Simpson's rule over the powers of a cosine."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = lambda end: f"list_sum(list_transform(range(0, {steps + 1}), lambda k: ({weight}) * power(cos(k * ({end}) / {steps}), {dof} - 1))) * ({end})"
    return f"greatest(0.0, 1 - ({area(f'atan(abs({t}) / sqrt({dof}))')}) / ({area('pi() / 2')}))"


def _rounded(body: str) -> str:
    return f"{BASE}, f AS ({body}) SELECT entity_id, round(COLUMNS(* EXCLUDE (entity_id))::DOUBLE, 6) FROM f"


def _sum(cond: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN d END), 0)"


def _ratio(a: str, b: str, other: str = "0") -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE {other} END"


def burden() -> str:
    w = ", ".join(f"{_sum(f't >= {s} AND t < {e}')} AS burden_minutes_{s}_{e}d, {_sum(f't >= {s} AND t < {e}')} / {e - s} AS burden_rate_{s}_{e}d" for s, e in WINDOWS)
    half1, half2 = _sum("t < fu / 2"), _sum("t >= fu / 2")
    q = ", ".join(f"CASE WHEN max(fu) > 0 THEN {_sum(f't >= fu * {k} / 4' + (f' AND t < fu * {k + 1} / 4' if k < 3 else ''))} END AS burden_q{k + 1}" for k in range(4))
    p = ", ".join(f"min(CASE WHEN cum >= total * {x} / 100 THEN t END) AS time_to_{x}pct_burden" for x in (25, 50, 75))
    return _rounded(f"""SELECT entity_id, sum(d) AS total_af_minutes, sum(d) / 60 AS total_af_hours, sum(d) / 1440 AS total_af_days, max(fu) AS follow_up_days,
      {_ratio("100 * sum(d)", "max(fu) * 1440")} AS af_burden_percent, {_ratio("sum(d)", "max(fu)")} AS af_burden_rate_per_day, 7 * {_ratio("sum(d)", "max(fu)")} AS af_burden_rate_per_week, {w},
      CASE WHEN max(fu) > 0 THEN {half1} ELSE 0 END AS burden_first_half, CASE WHEN max(fu) > 0 THEN {half2} ELSE 0 END AS burden_second_half,
      CASE WHEN NOT max(fu) > 0 THEN 1 WHEN {half1} > 0 THEN {half2} / {half1} WHEN {half2} > 0 THEN 'inf'::DOUBLE ELSE 1 END AS burden_ratio_second_first, {q},
      {_sum("t < 30")} AS burden_first_30d, {_sum("NOT t < 30")} AS burden_after_30d, {p} FROM e GROUP BY entity_id""")


def episode() -> str:
    pct = lambda x: f"100 * avg(CASE WHEN {x} THEN 1.0 ELSE 0 END)"
    some = lambda x: f"CASE WHEN count(*) >= 2 THEN {x} ELSE 0 END"
    gaps = ", ".join(f"{some(f'{f}(gap)')} AS {n}_inter_episode_interval" for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")))
    gap_pct = lambda k: f"100.0 * count(CASE WHEN gap < {k} THEN 1 END) / nullif(count(gap), 0)"
    return _rounded(f"""SELECT a.*, CASE WHEN a.n_episodes >= 2 AND l.last_t > 7 THEN CASE WHEN k.weeks = 1 THEN 1 ELSE k.fano END END AS fano_factor_weekly FROM
      (SELECT entity_id, count(*) AS n_episodes, {_ratio("count(*)", "max(t) / 7")} AS episode_rate_per_week, {_ratio("count(*)", "max(t) / 30.44")} AS episode_rate_per_month,
       avg(d) AS mean_episode_duration, median(d) AS median_episode_duration, max(d) AS max_episode_duration, min(d) AS min_episode_duration, stddev_pop(d) AS std_episode_duration,
       {_ratio("stddev_pop(d)", "avg(d)")} AS cv_episode_duration,
       CASE WHEN count(*) >= 3 THEN (avg(d * d * d) - 3 * avg(d) * avg(d * d) + 2 * power(avg(d), 3)) / nullif(power(stddev_pop(d), 3), 0) ELSE 0 END AS skew_episode_duration,
       quantile_cont(d, 0.25) AS duration_p25, quantile_cont(d, 0.75) AS duration_p75, quantile_cont(d, 0.9) AS duration_p90, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS duration_iqr,
       {pct("d < 60")} AS pct_episodes_lt_1h, {pct("d >= 60 AND d < 1440")} AS pct_episodes_1h_24h, {pct("d >= 1440")} AS pct_episodes_gt_24h, {pct("d >= 10080")} AS pct_episodes_gt_7d,
       count(CASE WHEN d >= 60 THEN 1 END) AS n_episodes_gt_1h, count(CASE WHEN d >= 1440 THEN 1 END) AS n_episodes_gt_24h, {gaps},
       {some(_ratio("stddev_pop(gap)", "avg(gap)"))} AS cv_inter_episode_interval, {some(_ratio("stddev_pop(gap) - avg(gap)", "stddev_pop(gap) + avg(gap)"))} AS burstiness_index,
       {some(gap_pct(1))} AS pct_intervals_lt_1d, {some(gap_pct(7))} AS pct_intervals_lt_7d FROM e GROUP BY entity_id) a
      JOIN (SELECT entity_id, max(t) AS last_t FROM e GROUP BY entity_id) l USING (entity_id)
      JOIN (SELECT entity_id, count(*) AS weeks, var_pop(c) / avg(c) AS fano FROM (SELECT entity_id, floor(t / 7) AS w, count(*) AS c FROM e GROUP BY ALL) GROUP BY entity_id) k USING (entity_id)""")


def temporal() -> str:
    ent = lambda x, name: f"(SELECT entity_id, abs(sum(c / n * log2(c / n))) AS {name} FROM (SELECT entity_id, {x} AS v, count(*)::DOUBLE AS c, any_value(n) AS n FROM e GROUP BY entity_id, v) GROUP BY entity_id)"
    return _rounded(f"""SELECT a.*, h.h AS hourly_entropy, h.h / log2(24) AS hourly_entropy_normalized, w.w AS dow_entropy, w.w / log2(7) AS dow_entropy_normalized, m.m AS monthly_entropy FROM
      (SELECT entity_id, count(*) FILTER (part = 'day') AS n_daytime_episodes, count(*) FILTER (part = 'night') AS n_nighttime_episodes, 100.0 * count(*) FILTER (part = 'day') / count(*) AS pct_daytime_episodes,
        CASE WHEN count(*) FILTER (part = 'night') > 0 THEN count(*) FILTER (part = 'day') / count(*) FILTER (part = 'night') WHEN count(*) FILTER (part = 'day') > 0 THEN 'inf'::DOUBLE ELSE 1 END AS day_night_ratio,
        {_ratio("100 * " + _sum("part = 'day'"), "sum(d)")} AS burden_pct_daytime, {_ratio("100 * " + _sum("part = 'night'"), "sum(d)")} AS burden_pct_nighttime,
        (degrees(atan2(avg(sin(hour(ts) * pi() / 12)), avg(cos(hour(ts) * pi() / 12)))) / 15 + 24) % 24 AS peak_hour,
        sqrt(power(avg(sin(hour(ts) * pi() / 12)), 2) + power(avg(cos(hour(ts) * pi() / 12)), 2)) AS hourly_concentration,
        100.0 * count(*) FILTER (isodow(ts) >= 6) / count(*) AS pct_weekend_episodes,
        CASE WHEN count(*) FILTER (isodow(ts) >= 6) > 0 THEN (count(*) FILTER (isodow(ts) < 6) / 5) / (count(*) FILTER (isodow(ts) >= 6) / 2) ELSE 'inf'::DOUBLE END AS weekday_weekend_ratio
       FROM e GROUP BY entity_id) a JOIN {ent("hour(ts)", "h")} h USING (entity_id) JOIN {ent("isodow(ts)", "w")} w USING (entity_id) JOIN {ent("month(ts)", "m")} m USING (entity_id)""")


def rr() -> str:
    return _rounded(f"""SELECT entity_id, count(rr) AS n_episodes_with_rr, 100.0 * count(rr) / count(*) AS pct_episodes_with_rr, avg(rr) AS mean_rr_interval, median(rr) AS median_rr_interval, stddev_pop(rr) AS std_rr_interval,
      min(rr) AS min_rr_interval, max(rr) AS max_rr_interval, {_ratio("stddev_pop(rr)", "avg(rr)")} AS cv_rr_interval, max(rr) - min(rr) AS range_rr_interval,
      avg(rate) AS mean_ventricular_rate, median(rate) AS median_ventricular_rate, stddev_pop(rate) AS std_ventricular_rate, min(rate) AS min_ventricular_rate, max(rate) AS max_ventricular_rate,
      100.0 * count(*) FILTER (rr < 545) / count(rr) AS pct_rapid_af, 100.0 * count(*) FILTER (rr BETWEEN 545 AND 1000) / count(rr) AS pct_controlled_rate,
      100.0 * count(*) FILTER (rr > 1000) / count(rr) AS pct_slow_rate, 100.0 * count(*) FILTER (rr < 400) / count(rr) AS pct_very_rapid,
      {_ratio("sum(rr * d)", "sum(d)", "avg(rr)")} AS duration_weighted_mean_rr, CASE WHEN count(rr) >= 3 THEN corr(rr, d) END AS rr_duration_correlation, CASE WHEN count(rr) >= 3 THEN {t_two_sided("(corr(rr, d) * sqrt((count(rr) - 2) / (1 - power(corr(rr, d), 2))))", "(count(rr) - 2)")} END AS rr_duration_correlation_pvalue FROM e GROUP BY entity_id""")


def trajectory() -> str:
    q = ", ".join(f"CASE WHEN max(fu) > 0 AND count(*) >= 4 THEN regr_slope(cum, t) FILTER (t >= fu * {k} / 4 AND t < {f'fu * {k + 1} / 4' if k < 3 else 'fu + 1'}) END AS slope_q{k + 1}" for k in range(4))
    p = ", ".join(f"min(CASE WHEN cum >= total * {x} / 100 THEN t END) AS time_to_{x}pct_burden_trajectory" for x in (25, 50, 75))
    share = lambda x: f"CASE WHEN count(*) >= 3 THEN 100 * {x} / sum(d) ELSE 100 END"
    return _rounded(f"""SELECT a.* EXCLUDE (many), {t_two_sided("(trajectory_slope / trajectory_slope_stderr)", "(many - 2)")} AS trajectory_slope_pvalue, slope_q4 / CASE WHEN slope_q1 > 0 THEN slope_q1 END AS slope_change_ratio, coalesce(longest, 0) >= 3 AS has_plateau, coalesce(longest, 0) AS longest_plateau_episodes,
        CASE WHEN longest >= 3 THEN onset END AS plateau_onset_days, quad.a AS trajectory_quadratic_coef, quad.b AS trajectory_linear_coef, sign(quad.a) AS trajectory_convexity FROM
      (SELECT entity_id, count(*) AS many, regr_slope(cum, t) AS trajectory_slope, regr_intercept(cum, t) AS trajectory_intercept, regr_r2(cum, t) AS trajectory_r_squared,
        sqrt((regr_syy(cum, t) - power(regr_sxy(cum, t), 2) / regr_sxx(cum, t)) / (count(*) - 2) / regr_sxx(cum, t)) AS trajectory_slope_stderr, {q}, {p},
        count(*) FILTER (d > 0.1 * total) AS n_major_steps, max(d) AS max_step_size_minutes, {share("max(d)")} AS max_step_size_pct, {share("sum(d) FILTER (big <= 3)")} AS top3_episode_contribution_pct,
        (sum((t - coalesce(t0, 0)) * (cum + cum0) / 2) + (max(fu) - max(t)) * sum(d)) / (sum(d) * max(fu)) AS trajectory_auc_normalized FROM e GROUP BY entity_id HAVING count(*) >= 3) a
      JOIN (SELECT entity_id, max(run) AS longest, min(t0) FILTER (run IS NOT NULL) AS onset FROM (
          SELECT entity_id, t0, CASE WHEN flat THEN count(*) OVER (PARTITION BY entity_id, flat, isl) END AS run FROM (
            SELECT *, rn - row_number() OVER (PARTITION BY entity_id, flat ORDER BY t, seq) AS isl FROM (
              SELECT *, coalesce(n >= 5 AND rise < quantile_cont(rise, 0.25) OVER (PARTITION BY entity_id), false) AS flat FROM (
                SELECT *, CASE WHEN t0 IS NOT NULL THEN d / CASE WHEN t = t0 THEN 1 ELSE t - t0 END END AS rise FROM e))))
          GROUP BY entity_id) r USING (entity_id)
      JOIN (SELECT entity_id, a, (uy - a * u3) / u2 - 2 * a * m AS b FROM (SELECT *, (u2y * u2 * n - uy * u3 * n - y * u2 * u2) / (u4 * u2 * n - u3 * u3 * n - u2 * u2 * u2) AS a FROM (
          SELECT entity_id, count(*) AS n, any_value(mean_t) AS m, sum(power(t - mean_t, 2)) AS u2, sum(power(t - mean_t, 3)) AS u3, sum(power(t - mean_t, 4)) AS u4, sum(cum) AS y, sum((t - mean_t) * cum) AS uy,
            sum(power(t - mean_t, 2) * cum) AS u2y FROM e GROUP BY entity_id))) quad USING (entity_id)""")


def queries() -> dict[str, str]:
    """The twins of the groups, of all features together, and of the groups over other encodings."""
    groups = {f"features_{g.__name__}": g() for g in (burden, episode, temporal, rr, trajectory)}
    joined = " JOIN ".join(f"({x}) g{i}" + (" USING (entity_id)" if i else "") for i, x in enumerate(groups.values()))
    flags = groups["features_temporal"].replace("CASE WHEN hour(ts) < 6 THEN 'night' ELSE 'day' END AS part", "CASE WHEN hour(ts) % 2 = 0 THEN 'day' ELSE 'night' END AS part")
    return groups | {"features_all": f"SELECT * FROM {joined}", "features_day_flags": flags, "features_without_rate": groups["features_rr"]}
