"""117 features of each entity's event history, in one shuffle.

All groups share one plan: events are exchanged by entity once; windows over
that partitioning add running sums, lags, totals and ranks; one aggregate gives
the base numbers; and projections derive the rest.  Definitions that a
denominator of zero leaves open give the stated constant, ``inf`` or NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.special import t_pvalue
from tidewheel.operators.events import WINDOWS, CleanConfig, align, clean

c, lit = F.col, F.lit
INF = float("inf")
MOST_DAYS = 365
SHARES = (25, 50, 75)

Group = dict[str, Column]


def _when_sum(cond: Column, value: str = "d") -> Column:
    return F.coalesce(F.sum(F.when(cond, c(value))), lit(0.0))


def _pct(cond: Column) -> Column:
    return 100.0 * F.avg(cond.cast("int"))


def _ratio(a: Column, b: Column, otherwise: Column | float | None) -> Column:
    """a / b where b is above 0."""
    return F.when(b > 0, a / b).otherwise(otherwise if isinstance(otherwise, Column) else lit(otherwise).cast("double"))


def _entropy(column: str, values: range) -> Column:
    """Shannon entropy in bits of a small integer column, in the same aggregate."""
    counts = [F.count_if(c(column) == k).cast("double") for k in values]
    total = reduce(lambda a, b: a + b, counts)
    terms = reduce(lambda a, b: a + b, [F.when(n > 0, n * F.log2(n)).otherwise(0.0) for n in counts])
    return F.when(total > 0, F.log2(total) - terms / total)


def prepare(events: DataFrame) -> DataFrame:
    """The windows that the groups read.  Needs entity_id, seq, start_ts, days, duration; rr, rate, day_part if there; without rates they are 60000 / rr."""
    have = set(events.columns)
    by = Window.partitionBy("entity_id")
    order = by.orderBy("t", "seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = lambda n: F.expr(f"try_cast({n} AS double)") if n in have else lit(None).cast("double")
    # Day parts are names, of which those with "night" are night, or flags, of which all but 0 and missing are day.
    part = c("day_part")
    night = F.lower(part).contains("night") if dict(events.dtypes).get("day_part") == "string" else ~F.coalesce(part.cast("double") != 0, lit(False))
    base = events.where("entity_id IS NOT NULL").select(
        "entity_id", "seq", "start_ts", c("days").alias("t"), c("duration").cast("double").alias("d"), number("rr").alias("rr"), (number("rate") if "rate" in have else F.when(number("rr") > 0, 60000 / number("rr"))).alias("rate"),
        (F.coalesce(night, lit(False)) if "day_part" in have else lit(None).cast("boolean")).alias("night"),
    )
    a = base.withColumns(
        {
            "rn": F.row_number().over(order), "n": F.count("*").over(by), "last_t": F.max("t").over(by), "total": F.sum("d").over(whole), "cum": F.sum("d").over(running),
            "t0": F.lag("t").over(order), "gap": (F.unix_micros(c("start_ts").cast("timestamp")) - F.lag(F.unix_micros(c("start_ts").cast("timestamp"))).over(by.orderBy("start_ts", "seq"))) / lit(86400e6),
            "big": F.row_number().over(by.orderBy(F.desc("d"), "t", "seq")), "hour": F.hour("start_ts"), "dow": F.weekday("start_ts"), "month": F.month("start_ts"),
            "week_rank": F.row_number().over(Window.partitionBy("entity_id", F.floor(c("t") / 7)).orderBy("t", "seq")), "week_n": F.count("*").over(Window.partitionBy("entity_id", F.floor(c("t") / 7))),
        }
    )
    b = a.withColumns({"fu": F.least("last_t", lit(float(MOST_DAYS))), "cum0": c("cum") - c("d"), "mean_t": F.avg("t").over(whole), "rise": F.when(c("t0").isNotNull(), c("d") / F.when(c("t") - c("t0") == 0, 1.0).otherwise(c("t") - c("t0")))})
    b = b.withColumn("flat", F.coalesce((c("n") >= 5) & (c("rise") < F.percentile("rise", lit(0.25)).over(by)), lit(False)))
    b = b.withColumn("island", c("rn") - F.row_number().over(Window.partitionBy("entity_id", "flat").orderBy("t", "seq")))
    # All sums go by time, so that their rounding, and what is next to a limit, does not depend on the order in which rows arrive.
    return b.withColumn("run", F.when(c("flat"), F.count("*").over(Window.partitionBy("entity_id", "flat", "island")))).sortWithinPartitions("entity_id", "t", "seq")


def burden(windows: tuple = WINDOWS) -> tuple[Group, Callable[[], Group]]:
    fu, t = c("fu"), c("t")
    base = {"total_af_minutes": F.coalesce(F.sum("d"), lit(0.0)), "follow_up_days": F.max("fu")}
    for s, e in windows:
        base[f"burden_minutes_{s}_{e}d"] = _when_sum((t >= s) & (t < e))
    base |= {"_half1": _when_sum(t < fu / 2), "_half2": _when_sum(t >= fu / 2)}
    for k in range(4):
        base[f"_quarter{k + 1}"] = _when_sum((t >= fu * k / 4) & ((t < fu * (k + 1) / 4) if k < 3 else lit(True)))
    base |= {"burden_first_30d": _when_sum(t < 30), "burden_after_30d": _when_sum(~F.coalesce(t < 30, lit(False)))}
    for p in SHARES:
        base[f"time_to_{p}pct_burden"] = F.min(F.when((c("total") > 0) & (c("cum") >= c("total") * p / 100), t))

    def derived() -> Group:
        total, f = c("total_af_minutes"), c("follow_up_days")
        out = {n: c(n) for n in base if not n.startswith("_")}
        out |= {"total_af_hours": total / 60, "total_af_days": total / 1440, "af_burden_percent": _ratio(100 * total, f * 1440, 0), "af_burden_rate_per_day": _ratio(total, f, 0), "af_burden_rate_per_week": _ratio(total, f, 0) * 7}
        out |= {f"burden_rate_{s}_{e}d": c(f"burden_minutes_{s}_{e}d") / (e - s) for s, e in windows}
        one, two = F.when(f > 0, c("_half1")).otherwise(0.0), F.when(f > 0, c("_half2")).otherwise(0.0)
        out |= {"burden_first_half": one, "burden_second_half": two}
        out["burden_ratio_second_first"] = F.when(~(f > 0), 1.0).when(one > 0, two / one).when(two > 0, INF).otherwise(1.0)
        return out | {f"burden_q{k}": F.when(f > 0, c(f"_quarter{k}")) for k in range(1, 5)}

    return base, derived


def episode() -> tuple[Group, Callable[[], Group]]:
    d, gap = c("d"), c("gap")
    weeks = F.when(c("week_rank") == 1, c("week_n"))
    base = {
        "n_episodes": F.count("*"), "_last_t": F.max("t"), "mean_episode_duration": F.avg("d"), "max_episode_duration": F.max("d"), "min_episode_duration": F.min("d"), "std_episode_duration": F.stddev_pop("d"), "_skew": F.skewness("d"),
        "_p": F.percentile("d", F.array(*[lit(x) for x in (0.25, 0.5, 0.75, 0.9)])), "pct_episodes_lt_1h": _pct(d < 60), "pct_episodes_1h_24h": _pct((d >= 60) & (d < 1440)), "pct_episodes_gt_24h": _pct(d >= 1440), "pct_episodes_gt_7d": _pct(d >= 10080),
        "n_episodes_gt_1h": F.count_if(d >= 60), "n_episodes_gt_24h": F.count_if(d >= 1440), "_gap_mean": F.avg("gap"), "_gap_median": F.percentile("gap", lit(0.5)), "_gap_min": F.min("gap"), "_gap_max": F.max("gap"), "_gap_std": F.stddev_pop("gap"),
        "_lt1": _pct(gap < 1), "_lt7": _pct(gap < 7), "_weeks": F.count(weeks), "_week_var": F.var_pop(weeks), "_week_mean": F.avg(weeks),
    }

    def derived() -> Group:
        out = {n: c(n) for n in base if not n.startswith("_")}
        n, last = c("n_episodes"), c("_last_t")
        out |= {"episode_rate_per_week": _ratio(n, last / 7, 0), "episode_rate_per_month": _ratio(n, last / 30.44, 0), "cv_episode_duration": _ratio(c("std_episode_duration"), c("mean_episode_duration"), 0), "skew_episode_duration": F.when(n >= 3, c("_skew")).otherwise(0.0)}
        out |= {name: F.get("_p", lit(i)) for i, name in enumerate(("duration_p25", "median_episode_duration", "duration_p75", "duration_p90"))}
        out["duration_iqr"] = F.get("_p", lit(2)) - F.get("_p", lit(0))
        some = lambda x: F.when(n >= 2, x).otherwise(0.0)
        out |= {f"{k}_inter_episode_interval": some(c(f"_gap_{k}")) for k in ("mean", "median", "min", "max", "std")}
        mean, std = c("_gap_mean"), c("_gap_std")
        out |= {"cv_inter_episode_interval": some(_ratio(std, mean, 0)), "burstiness_index": some(_ratio(std - mean, std + mean, 0)), "pct_intervals_lt_1d": some(c("_lt1")), "pct_intervals_lt_7d": some(c("_lt7"))}
        out["fano_factor_weekly"] = F.when((n >= 2) & (last > 7), F.when(c("_weeks") == 1, 1.0).otherwise(c("_week_var") / c("_week_mean")))
        return out

    return base, derived


def temporal() -> tuple[Group, Callable[[], Group]]:
    night = F.coalesce("night", lit(False))
    base = {"n_daytime_episodes": F.count_if(~night), "n_nighttime_episodes": F.count_if(night), "_day": _when_sum(~night), "_night": _when_sum(night), "_all": F.sum("d"), "_n": F.count("*"), "_parts": F.count("night")}
    angle = c("hour") * math.pi / 12  # in this order, as the SQL twin has it: where hours cancel out, the last digit is all that is left
    base |= {"_sin": F.avg(F.sin(angle)), "_cos": F.avg(F.cos(angle)), "hourly_entropy": _entropy("hour", range(24)), "dow_entropy": _entropy("dow", range(7)), "monthly_entropy": _entropy("month", range(1, 13)), "_end": F.count_if(c("dow") >= 5), "_dows": F.count("dow")}

    def derived() -> Group:
        day, night_, n = c("n_daytime_episodes"), c("n_nighttime_episodes"), c("_n")
        # Without day parts the table has no such column.
        if_known = lambda x: F.when(c("_parts") > 0, x)
        out = {"n_daytime_episodes": if_known(day), "n_nighttime_episodes": if_known(night_), "pct_daytime_episodes": if_known(100.0 * day / n)}
        out["day_night_ratio"] = if_known(F.when(night_ > 0, day / night_).when(day > 0, INF).otherwise(1.0))
        out |= {"burden_pct_daytime": if_known(_ratio(100 * c("_day"), c("_all"), 0)), "burden_pct_nighttime": if_known(_ratio(100 * c("_night"), c("_all"), 0))}
        out |= {"peak_hour": F.pmod(F.atan2("_sin", "_cos") * (24 / (2 * math.pi)), lit(24.0)), "hourly_concentration": F.sqrt(c("_sin") ** 2 + c("_cos") ** 2)}
        out |= {"hourly_entropy": c("hourly_entropy"), "hourly_entropy_normalized": c("hourly_entropy") / math.log2(24), "dow_entropy": c("dow_entropy"), "dow_entropy_normalized": c("dow_entropy") / math.log2(7), "monthly_entropy": c("monthly_entropy")}
        end, work = c("_end"), c("_dows") - c("_end")
        timed = lambda x: F.when(c("_dows") > 0, x)
        return out | {"pct_weekend_episodes": timed(100.0 * end / c("_dows")), "weekday_weekend_ratio": timed(F.when(end > 0, (work / 5) / (end / 2)).otherwise(INF))}

    return base, derived


def rate() -> tuple[Group, Callable[[], Group]]:
    rr, d = c("rr"), c("d")
    known = rr.isNotNull()
    both = known & d.isNotNull()
    cov = F.avg(F.when(both, rr * d)) - F.avg(F.when(both, rr)) * F.avg(F.when(both, d))
    base = {
        "n_episodes_with_rr": F.count("rr"), "_n": F.count("*"), "mean_rr_interval": F.avg("rr"), "median_rr_interval": F.percentile("rr", lit(0.5)), "std_rr_interval": F.stddev_pop("rr"), "min_rr_interval": F.min("rr"), "max_rr_interval": F.max("rr"),
        "mean_ventricular_rate": F.avg("rate"), "median_ventricular_rate": F.percentile("rate", lit(0.5)), "std_ventricular_rate": F.stddev_pop("rate"), "min_ventricular_rate": F.min("rate"), "max_ventricular_rate": F.max("rate"),
        "pct_rapid_af": _pct(rr < 545), "pct_controlled_rate": _pct((rr >= 545) & (rr <= 1000)), "pct_slow_rate": _pct(rr > 1000), "pct_very_rapid": _pct(rr < 400),
        "_weighted": F.sum(F.when(known, rr * d)), "_weight": F.sum(F.when(known, d)), "_cov": cov, "_sd_rr": F.stddev_pop(F.when(both, rr)), "_sd_d": F.stddev_pop(F.when(both, d)),
    }

    def derived() -> Group:
        out = {n: c(n) for n in base if not n.startswith("_")}
        out |= {"pct_episodes_with_rr": 100.0 * c("n_episodes_with_rr") / c("_n"), "cv_rr_interval": _ratio(c("std_rr_interval"), c("mean_rr_interval"), F.when(c("mean_rr_interval").isNotNull(), 0.0)), "range_rr_interval": c("max_rr_interval") - c("min_rr_interval")}
        out["duration_weighted_mean_rr"] = F.when(c("_weight") > 0, c("_weighted") / c("_weight")).otherwise(c("mean_rr_interval"))
        r = F.when(c("n_episodes_with_rr") >= 3, c("_cov") / F.nullif(c("_sd_rr") * c("_sd_d"), lit(0.0)))
        dof = c("n_episodes_with_rr") - 2
        return out | {"rr_duration_correlation": r, "rr_duration_correlation_pvalue": t_pvalue(r * F.sqrt(dof / F.nullif(1 - r * r, lit(0.0))), dof.cast("double"))}

    return base, derived


def _line(x: str, y: str, cond: Column) -> Column:
    """Least-squares slope of y on x over the rows where cond holds, NULL below two points or for constant x.  Moments are about the means, so that no digits cancel."""
    return F.regr_slope(F.when(cond, c(y)), F.when(cond, c(x)))


def trajectory() -> tuple[Group, Callable[[], Group]]:
    t, fu = c("t"), c("fu")
    base = {"_n": F.count("*"), "_fu": F.max("fu"), "_total": F.sum("d"), "_slope": F.regr_slope("cum", "t"), "_icept": F.regr_intercept("cum", "t"), "_sxx": F.regr_sxx("cum", "t"), "_syy": F.regr_syy("cum", "t"), "_sxy": F.regr_sxy("cum", "t")}
    u = c("t") - c("mean_t")  # centred, so that powers stay small
    base |= {"_mean_t": F.max("mean_t")} | {f"_u{k}": F.sum(u**k) for k in (2, 3, 4)} | {"_y": F.sum("cum"), "_uy": F.sum(u * c("cum")), "_u2y": F.sum(u * u * c("cum"))}
    for k in range(4):
        high = fu * (k + 1) / 4 if k < 3 else fu + 1
        base[f"_q{k + 1}"] = F.when(F.max("fu") > 0, F.when(F.count("*") >= 4, _line("t", "cum", (t >= fu * k / 4) & (t < high))))
    base |= {"_longest": F.max("run"), "_onset": F.min(F.when(c("flat"), c("t0")))}
    for p in SHARES:
        base[f"time_to_{p}pct_burden_trajectory"] = F.min(F.when((c("total") > 0) & (c("cum") >= c("total") * p / 100), t))
    base |= {"_steps": F.count_if(c("d") > c("total") * 0.1), "max_step_size_minutes": F.max("d"), "_top3": F.sum(F.when(c("big") <= 3, c("d")))}
    base["_area"] = F.sum((t - F.coalesce("t0", lit(0.0))) * (c("cum") + c("cum0")) / 2)
    base["_last"] = F.max("last_t")

    def derived() -> Group:
        n, f, total = c("_n"), c("_fu"), c("_total")
        many = n >= 2
        slope = F.when(many, c("_slope")).otherwise(_ratio(total, f, 0))
        # A constant y fits exactly.
        r2 = F.when(~many, 1.0).when(c("_sxx") > 0, F.when(c("_syy") > 0, c("_sxy") ** 2 / (c("_sxx") * c("_syy"))).otherwise(1.0))
        dof = F.when(n > 2, (n - 2).cast("double"))
        err = F.when(many, F.sqrt(F.greatest(c("_syy") - c("_sxy") ** 2 / F.nullif(c("_sxx"), lit(0.0)), lit(0.0)) / dof / F.nullif(c("_sxx"), lit(0.0))))
        out = {"trajectory_slope": slope, "trajectory_intercept": F.when(many, c("_icept")).otherwise(0.0), "trajectory_r_squared": r2, "trajectory_slope_stderr": err, "trajectory_slope_pvalue": t_pvalue(slope / F.nullif(err, lit(0.0)), dof)}
        # Normal equations of y = a u^2 + b u + k with sum(u) = 0.
        u2, u3, u4 = c("_u2"), c("_u3"), c("_u4")
        det = u4 * u2 * n - u3 * u3 * n - u2 * u2 * u2
        a = (c("_u2y") * u2 * n - c("_uy") * u3 * n - c("_y") * u2 * u2) / F.nullif(det, lit(0.0))
        b = (c("_uy") - a * u3) / F.nullif(u2, lit(0.0))
        three = n >= 3
        out |= {"trajectory_quadratic_coef": F.when(three, a).otherwise(0.0), "trajectory_linear_coef": F.when(three, b - 2 * a * c("_mean_t")).otherwise(slope), "trajectory_convexity": F.when(three, F.signum(a)).otherwise(0.0)}
        out |= {f"slope_q{k}": c(f"_q{k}") for k in range(1, 5)} | {"slope_change_ratio": F.when(c("_q1") > 0, c("_q4") / c("_q1"))}
        longest = F.coalesce("_longest", lit(0))
        out |= {"has_plateau": longest >= 3, "longest_plateau_episodes": longest, "plateau_onset_days": F.when(longest >= 3, c("_onset"))}
        out |= {x: c(x) for x in base if not x.startswith("_")}
        out["n_major_steps"] = F.when(three, c("_steps")).otherwise(n)
        share = lambda x: F.when(three, 100 * x / F.nullif(total, lit(0.0))).otherwise(100.0)
        out |= {"max_step_size_pct": share(c("max_step_size_minutes")), "top3_episode_contribution_pct": share(c("_top3"))}
        closing = (f - c("_last")) * total
        return out | {"trajectory_auc_normalized": F.when(many & (f > 0) & (total > 0), (c("_area") + closing) / (total * f)).otherwise(0.5)}

    return base, derived


GROUPS = {"burden": burden, "episode": episode, "temporal": temporal, "rr": rate, "trajectory": trajectory}


def extract(events: DataFrame, groups: tuple[str, ...] = tuple(GROUPS), windows: tuple = WINDOWS) -> DataFrame:
    """One row per entity with the features of the named groups.  Unknown names raise; so does an empty choice."""
    unknown = set(groups) - set(GROUPS)
    if unknown or not groups:
        raise ValueError(f"no such feature group: {sorted(unknown)}" if unknown else "no feature group was named")
    built = {g: burden(windows) if g == "burden" else GROUPS[g]() for g in groups}
    inner = lambda g, n: f"{g}__{n}"
    sums = [e.alias(inner(g, n)) for g, (base, _) in built.items() for n, e in base.items()]
    wide = prepare(events).groupBy("entity_id").agg(*sums)
    out = wide
    names = []
    for g, (base, derived) in built.items():
        # Each group's projection sees its own base columns by their short names.
        short = out.select("entity_id", *names, *[c(inner(g, n)).alias(n) for n in base if n not in names], *[c(x) for x in out.columns if "__" in x and not x.startswith(f"{g}__")])
        found = derived()
        kept = [x for x in short.columns if "__" in x]
        out = short.select("entity_id", *[c(x) for x in names], *[e.alias(n) for n, e in found.items()], *[c(x) for x in kept])
        names += list(found)
    return out.select("entity_id", *names)


def feature_table(raw: DataFrame, config: CleanConfig = CleanConfig(), max_days: float | None = MOST_DAYS, groups: tuple[str, ...] = tuple(GROUPS), windows: tuple = WINDOWS) -> DataFrame:  # noqa: B008
    """From raw events to features in one call: cleaned, aligned, extracted."""
    return extract(align(clean(raw, config), max_days), groups, windows)


def names(groups: tuple[str, ...] = tuple(GROUPS), windows: tuple = WINDOWS) -> list[str]:
    """The feature names of the groups, in order."""
    return [n for g in groups for n in (burden(windows) if g == "burden" else GROUPS[g]())[1]()]
