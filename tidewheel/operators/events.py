"""Cleaning and alignment of event histories.

The event schema is ``entity_id, seq, start_ts, duration, anchor_ts, rr, rate,
day_part``; columns that a table lacks are simply not there and what needs
them is skipped.  Missing is NULL everywhere: NaN becomes NULL at ingest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default bounds, follow-up windows in days, days of a month, edges of duration bins in minutes.
WINDOWS = ((0, 30), (30, 90), (90, 180), (180, 365))
DAYS_A_MONTH = 30.44
DURATION_EDGES = (0, 2, 6, 60, 1440, 10080)


@dataclass(frozen=True)
class CleanConfig:
    min_duration: float = 0
    max_duration: float = 10080
    min_rr: float = 200
    max_rr: float = 2000
    drop_zero: bool = True
    drop_overlaps: bool = False


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def overlaps_previous(df: DataFrame) -> Column:
    """True where an event starts before the previous one of its entity ends."""
    w = Window.partitionBy("entity_id").orderBy("start_ts", "seq")
    end = F.col("start_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("duration").cast("decimal(18,6)").cast("int"), ((F.col("duration") % 1) * 60).cast("decimal(18,6)"))
    return F.coalesce(F.lag(end).over(w) > F.col("start_ts"), F.lit(False))


def removal_reason(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Add ``reason``: the first cleaning rule that removes the event, NULL if it stays.

    A missing duration removes nothing; a rate interval is judged only if it is a number.
    """
    d, rr = F.col("duration"), F.expr("try_cast(rr AS double)") if "rr" in df.columns else F.lit(None).cast("double")
    rules = [("negative", d < 0)]
    if config.drop_zero:
        rules.append(("zero", d == 0))
    if config.min_duration > 0:
        rules.append(("too_short", d < config.min_duration))
    rules += [("too_long", d > config.max_duration), ("no_start", F.col("start_ts").isNull()), ("rate", (rr < config.min_rr) | (rr > config.max_rr))]
    chain = reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), r[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0]))
    out = df.withColumn("reason", chain)
    if config.drop_overlaps:
        kept = out.where("reason IS NULL")
        marked = kept.withColumn("reason", F.when(overlaps_previous(kept), "overlap"))
        out = out.where("reason IS NOT NULL").unionByName(marked)
    return out


def clean(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """The events that no rule removes."""
    return removal_reason(df, config).where("reason IS NULL").drop("reason")


def cleaning_report(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """One row: events before and after, removals by rule, retention in per cent, entities affected."""
    gone = F.col("reason").isNotNull()
    names = ["negative", "zero", "too_short", "too_long", "no_start", "rate", "overlap"]
    return removal_reason(df, config).agg(
        F.count("*").alias("n_original"),
        F.count_if(~gone).alias("n_kept"),
        *[F.count_if(F.col("reason") == n).alias(f"n_{n}") for n in names],
        F.coalesce(100.0 * F.try_divide(F.count_if(~gone), F.count("*")), F.lit(0.0)).alias("retention_pct"),
        F.count_distinct(F.when(gone, F.col("entity_id"))).alias("n_entities_affected"),
    )


def validity_flags(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Add ``valid_duration`` (strictly above the least), ``valid_timestamp``, ``valid_rr`` and ``valid``; nothing is removed."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    rr = F.expr("try_cast(rr AS double)") if "rr" in df.columns else F.lit(None).cast("double")
    out = df.withColumns(
        {
            "valid_duration": sure((F.col("duration") > config.min_duration) & (F.col("duration") <= config.max_duration)),
            "valid_timestamp": F.col("start_ts").isNotNull(),
            "valid_rr": rr.isNull() | sure(rr.between(config.min_rr, config.max_rr)),
        }
    )
    return out.withColumn("valid", F.expr("valid_duration AND valid_timestamp AND valid_rr"))


def invalid_events(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    return validity_flags(df, config).where("NOT valid")


def entity_summary(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Per entity: events, valid and invalid ones, sum, mean and maximum of durations, share of valid ones."""
    return (
        validity_flags(df.where("entity_id IS NOT NULL"), config)
        .groupBy("entity_id")
        .agg(
            F.count("*").alias("n_events"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.sum("duration").alias("total_duration"),
            F.avg("duration").alias("mean_duration"), F.max("duration").alias("max_duration"), (100.0 * F.count_if("valid") / F.count("*")).alias("pct_valid"),
        )
    )


def align(df: DataFrame, max_days: float | None = 365, keep_before: bool = False) -> DataFrame:
    """Add ``days``, ``weeks`` and ``months`` since the anchor; drop events before it or after ``max_days``.

    An event without a time or an anchor stays, as nothing says that it is outside.
    """
    days = F.timestamp_diff("MICROSECOND", F.col("anchor_ts"), F.col("start_ts")) / F.lit(86400e6)
    out = df.withColumn("days", days)
    if not keep_before:
        out = out.where(~F.coalesce(F.col("days") < 0, F.lit(False)))
    if max_days is not None:
        out = out.where(~F.coalesce(F.col("days") > max_days, F.lit(False)))
    return out.withColumns({"weeks": F.col("days") / 7, "months": F.col("days") / DAYS_A_MONTH})


def normalised_time(df: DataFrame, period: float = 365) -> DataFrame:
    """Add ``normalised_time``: days since the anchor as a share of a reference period."""
    return df.withColumn("normalised_time", _days(df) / F.lit(float(period)))


def _days(df: DataFrame) -> Column:
    """The days since the anchor: the column of aligned events, else computed."""
    return F.col("days") if "days" in df.columns else F.timestamp_diff("MICROSECOND", F.col("anchor_ts"), F.col("start_ts")) / F.lit(86400e6)


def window_label(days: Column, windows: tuple = WINDOWS) -> Column:
    """``{start}-{end}d`` of the first window with start <= days < end, else ``other``."""
    label = lambda w: f"{w[0]}-{w[1]}d"
    inside = lambda w: (days >= w[0]) & (days < w[1])
    return reduce(lambda c, w: c.when(inside(w), label(w)), windows[1:], F.when(inside(windows[0]), label(windows[0]))).otherwise("other")


def duration_bin(duration: Column) -> Column:
    """Right-closed bins between DURATION_EDGES: the number of edges below the value; NULL at or below 0."""
    return F.when(duration > 0, reduce(lambda a, b: a + b, [(duration > e).cast("int") for e in DURATION_EDGES]))


def follow_up(df: DataFrame) -> DataFrame:
    """Per entity: first and last day, events, span, follow-up."""
    return df.groupBy("entity_id").agg(F.min("days").alias("first_day"), F.max("days").alias("last_day"), F.count("*").alias("n_events"), (F.max("days") - F.min("days")).alias("span_days"), F.max("days").alias("follow_up_days"))


def daily(df: DataFrame, how: str = "sum") -> DataFrame:
    """Durations by entity and whole day: ``sum``, ``count`` or ``mean``; days without events have no row."""
    ways = {"sum": F.sum, "count": F.count, "mean": F.avg}
    if how not in ways:
        raise ValueError(f"unknown aggregation {how!r}")
    return df.groupBy("entity_id", F.floor("days").cast("int").alias("day")).agg(ways[how]("duration").alias("value"))


def cumulative_burden(df: DataFrame) -> DataFrame:
    """Add the running sum of durations of each entity, in minutes, hours and days."""
    w = Window.partitionBy("entity_id").orderBy("days", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("cum_minutes", F.sum("duration").over(w))
    return out.withColumns({"cum_hours": F.col("cum_minutes") / 60, "cum_days": F.col("cum_minutes") / 1440})
