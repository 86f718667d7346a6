"""Regular series of entities, discrete states and their dynamics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.neighbours import all_pairs, indexed, pairwise
from tidewheel.operators.stats import quantiles

c, lit = F.col, F.lit

#: Burden cut-offs of the clinical states, in minutes a week and a day.
CLINICAL = {"weekly": (50.4, 201.6), "daily": (7.2, 28.8)}


def n_timepoints(resolution: str, max_days: int) -> int:
    """Points of a series: one a day, week or month of the follow-up; 100 for any other name."""
    return {"daily": max_days, "weekly": max_days // 7, "monthly": max_days // 30}.get(resolution, 100)


def _events(events: DataFrame, max_days: float) -> DataFrame:
    return events.where(c("entity_id").isNotNull() & (c("days") >= 0) & (c("days") <= max_days)).select("entity_id", "seq", c("days").alias("t"), c("duration").alias("d"))


def _grid(ids: DataFrame, n: int, step: float) -> DataFrame:
    """(entity_id, pos, x) with x = pos * step, pos = 0 .. n-1."""
    return ids.select("entity_id", F.explode(F.sequence(lit(0), lit(n - 1))).alias("pos")).withColumn("x", c("pos") * step)


def cumulative_series(events: DataFrame, n: int, max_days: float) -> DataFrame:
    """Running burden on an even grid over [0, max_days]: linear between events, from (0, 0) to the last sum.

    Of several events at one time the last sum counts.  Knots and grid points are
    merged by one window per entity, so no entity's series is joined with itself.
    """
    own = _events(events, max_days)
    running = Window.partitionBy("entity_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    knots = own.withColumn("y", F.sum("d").over(running)).select("entity_id", c("t").alias("x"), "y").distinct()
    ends = own.groupBy("entity_id").agg(F.sum("d").alias("y"), F.min("t").alias("first"))
    ids = ends.select("entity_id")
    knots = knots.unionByName(ends.where("first > 0").select("entity_id", lit(0.0).alias("x"), lit(0.0).alias("y"))).unionByName(ends.select("entity_id", lit(float(max_days)).alias("x"), "y"))
    knots = knots.groupBy("entity_id", "x").agg(F.max("y").alias("y")).withColumn("pos", lit(None).cast("int"))
    grid = _grid(ids, n, max_days / (n - 1) if n > 1 else 0.0).withColumn("y", lit(None).cast("double"))
    both = knots.unionByName(grid.select(*knots.columns))
    order = Window.partitionBy("entity_id").orderBy("x", c("pos").asc_nulls_first())
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    knot = F.when(c("pos").isNull(), F.struct("x", "y"))
    found = both.withColumns({"a": F.last(knot, ignorenulls=True).over(back), "b": F.first(knot, ignorenulls=True).over(ahead)}).where("pos IS NOT NULL")
    between = c("a.y") + (c("b.y") - c("a.y")) * (c("x") - c("a.x")) / F.nullif(c("b.x") - c("a.x"), lit(0.0))
    return found.select("entity_id", "pos", c("x").alias("time"), F.greatest(F.coalesce(between, c("a.y")), lit(0.0)).alias("value"))


def rate_series(events: DataFrame, n: int, max_days: float) -> DataFrame:
    """Burden per day in n equal bins of [0, max_days]; the last bin holds its right edge."""
    width = max_days / n
    own = _events(events, max_days)
    sums = own.groupBy("entity_id", F.least(F.floor(c("t") / width), lit(n - 1)).cast("int").alias("pos")).agg(F.sum("d").alias("s"))
    grid = _grid(own.select("entity_id").distinct(), n, width)
    return grid.join(sums, ["entity_id", "pos"], "left").select("entity_id", "pos", c("x").alias("time"), (F.coalesce("s", lit(0.0)) / width).alias("value"))


def count_series(events: DataFrame, n: int, max_days: float) -> DataFrame:
    """Events so far on an even grid over [0, max_days]."""
    own = _events(events, max_days)
    step = max_days / (n - 1) if n > 1 else float(max_days)
    # The first grid point at or after an event counts it; running sums do the rest.
    firsts = own.groupBy("entity_id", F.ceil(c("t") / step).cast("int").alias("pos")).agg(F.count("*").alias("k"))
    grid = _grid(own.select("entity_id").distinct(), n, step)
    w = Window.partitionBy("entity_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(firsts, ["entity_id", "pos"], "left").select("entity_id", "pos", c("x").alias("time"), F.sum(F.coalesce("k", lit(0))).over(w).cast("double").alias("value"))


SERIES = {"cumulative_burden": cumulative_series, "burden_rate": rate_series, "episode_count": count_series}


def dataset(events: DataFrame, representation: str = "cumulative_burden", resolution: str = "weekly", max_days: int = 365, standardise: bool = False) -> DataFrame:
    """Long series (entity_id, pos, time, value) in one of three representations."""
    if representation not in SERIES:
        raise ValueError(f"unknown representation {representation!r}")
    out = SERIES[representation](events, n_timepoints(resolution, max_days), max_days)
    return normalise(out, "zscore") if standardise else out


def normalise(series: DataFrame, method: str) -> DataFrame:
    """Per entity: ``minmax`` to 0..1, ``zscore`` (population), or ``endpoint`` (by the last value if above 0)."""
    by = Window.partitionBy("entity_id")
    v = c("value")
    if method == "zscore":
        sd = F.stddev_pop("value").over(by)
        new = F.when(sd > 0, (v - F.avg("value").over(by)) / sd).otherwise(v - F.avg("value").over(by))
    elif method == "minmax":
        low, high = F.min("value").over(by), F.max("value").over(by)
        new = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    elif method == "endpoint":
        last = F.max_by("value", "pos").over(by)
        new = F.when(last > 0, v / last).otherwise(v)
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return series.withColumn("value", new)


def arrays(series: DataFrame) -> DataFrame:
    """(entity_id, values): each entity's series as one array, in order; a series has a fixed length."""
    return series.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def _numbered(series: DataFrame) -> DataFrame:
    return indexed(arrays(series), "entity_id", "values")


def distances(series: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(a, b, distance) for every pair of entities a < b of a cohort, by equal positions: ``euclidean``, ``cosine`` or ``correlation``."""
    return pairwise(_numbered(series), metric, "entity_id").withColumnRenamed("d", "distance")


#: Parameter: series that are warped against a tile at once.
ROWS = 64


def dtw_distances(series: DataFrame, band: int | None = None) -> DataFrame:
    """(a, b, distance): dynamic time warping with absolute costs for every pair a < b of a cohort.

    Some series and a tile are one programme over the cells of the cost table, run for all their pairs at once.
    """

    def warp(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([block(x[at : at + ROWS], y) for at in range(0, len(x), ROWS)])

    def block(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n, m = p.shape[1], q.shape[1]
        row = np.full((m + 1, len(p), len(q)), np.inf)
        row[0] = 0
        for i in range(n):
            new = np.full_like(row, np.inf)
            for j in range(m) if band is None else range(max(0, i - band), min(m, i + band + 1)):
                new[j + 1] = np.abs(p[:, i, None] - q[None, :, j]) + np.minimum(np.minimum(row[j + 1], row[j]), new[j])
            row = new
        return row[m]

    return all_pairs(_numbered(series), warp, "entity_id").withColumnRenamed("d", "distance")


def day_trajectory(events: DataFrame, days: int = 365) -> DataFrame:
    """Burden of events up to each whole day 0 .. days: an event at 3.4 days counts from day 4."""
    own = _events(events, days)
    sums = own.groupBy("entity_id", F.ceil("t").cast("int").alias("pos")).agg(F.sum("d").alias("s"))
    grid = _grid(own.select("entity_id").distinct(), days + 1, 1.0)
    w = Window.partitionBy("entity_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(sums, ["entity_id", "pos"], "left").select("entity_id", "pos", F.sum(F.coalesce("s", lit(0.0))).over(w).alias("value"))


def group_curve(series: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Mean and normal 95 % interval of a series per group and position (population sd)."""
    out = series.join(groups.select("entity_id", by), "entity_id").groupBy(by, "pos").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    half = 1.96 * c("sd") / F.sqrt("n")
    return out.select(by, "pos", "n", "mean", (c("mean") - half).alias("low"), (c("mean") + half).alias("high"))


def own_trajectory(events: DataFrame, n: int = 100, max_days: float = 365) -> DataFrame:
    """(entity_id, pos, time, value): the running burden on an even grid of n points over each entity's own follow-up, never below 0.

    The grid ends at the last event or ``max_days``; between events the burden is linear, from (0, 0).
    """
    own = events.where("entity_id IS NOT NULL AND days IS NOT NULL").select("entity_id", "seq", c("days").alias("t"), c("duration").alias("d"))
    running = Window.partitionBy("entity_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    knots = own.withColumn("y", F.sum("d").over(running)).groupBy("entity_id", c("t").alias("x")).agg(F.max_by("y", "seq").alias("y"))
    ends = own.groupBy("entity_id").agg(F.least(F.max("t"), lit(float(max_days))).alias("last"), F.min("t").alias("first"))
    knots = knots.unionByName(ends.where("first > 0").select("entity_id", lit(0.0).alias("x"), lit(0.0).alias("y"))).withColumn("pos", lit(None).cast("int"))
    grid = ends.select("entity_id", "last", F.explode(F.sequence(lit(0), lit(n - 1))).alias("pos")).select("entity_id", (c("pos") * c("last") / max(1, n - 1)).alias("x"), lit(None).cast("double").alias("y"), "pos")
    order = Window.partitionBy("entity_id").orderBy("x", c("pos").asc_nulls_first())
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    knot = F.when(c("pos").isNull(), F.struct("x", "y"))
    found = knots.select("entity_id", "x", "y", "pos").unionByName(grid).withColumns({"a": F.last(knot, ignorenulls=True).over(back), "b": F.first(knot, ignorenulls=True).over(ahead)}).where("pos IS NOT NULL")
    between = c("a.y") + (c("b.y") - c("a.y")) * (c("x") - c("a.x")) / F.nullif(c("b.x") - c("a.x"), lit(0.0))
    return found.select("entity_id", "pos", c("x").alias("time"), F.greatest(F.coalesce(between, c("a.y"), lit(0.0)), lit(0.0)).alias("value"))


# States


def unit_burden(events: DataFrame, resolution: str = "weekly") -> DataFrame:
    """Burden by entity and whole week or day.

    Durations are added up by time, so that equal burdens are equal to the last bit whatever the order in which rows arrive: states have sharp cut-offs.
    """
    width = 7 if resolution == "weekly" else 1
    own = events.where("entity_id IS NOT NULL").select("entity_id", F.floor(c("days") / width).cast("int").alias("unit"), "days", "seq", "duration")
    upto = Window.partitionBy("entity_id", "unit").orderBy("days", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("upto", F.sum("duration").over(upto)).groupBy("entity_id", "unit").agg(F.max_by("upto", F.struct("days", "seq")).alias("burden"))


def thresholds(units: DataFrame, n_states: int = 3, method: str = "burden_level", resolution: str = "weekly") -> list[float]:
    """Cut-offs between states: even percentiles of positive burdens, clinical values, or the 33rd and 67th percentile."""
    if method == "clinical":
        return list(CLINICAL["weekly" if resolution == "weekly" else "daily"])
    shares = [i / n_states for i in range(1, n_states)] if method == "burden_level" else [0.33, 0.67]
    found = quantiles(units.where("burden > 0"), "burden", tuple(shares)).first()
    return list(found["p"]) if found else [0.0] * len(shares)


def states(units: DataFrame, cuts: list[float], n_units: int) -> DataFrame:
    """(entity_id, unit, state) for units 0 .. n_units-1; without events the burden is 0; a value on a cut-off is above it."""
    grid = units.select("entity_id").distinct().select("entity_id", F.explode(F.sequence(lit(0), lit(n_units - 1))).alias("unit"))
    burden = F.coalesce("burden", lit(0.0))
    level = sum(((burden >= x).cast("int") for x in cuts), lit(0))
    return grid.join(units, ["entity_id", "unit"], "left").select("entity_id", "unit", level.alias("state"))


def state_features(seq: DataFrame, n_states: int = 3) -> DataFrame:
    """Per entity: shares, dominant and final state, transitions, first high state, entropy and runs."""
    order = Window.partitionBy("entity_id").orderBy("unit")
    a = seq.withColumns({"before": F.lag("state").over(order), "island": F.row_number().over(order) - F.row_number().over(Window.partitionBy("entity_id", "state").orderBy("unit"))})
    a = a.withColumn("run", F.count("*").over(Window.partitionBy("entity_id", "state", "island")))
    n = F.count("*")
    counts = [F.count_if(c("state") == k) for k in range(n_states)]
    moved = c("state") != c("before")
    entropy = -sum((F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0) for k in counts), lit(0.0))
    out = a.groupBy("entity_id").agg(
        *[(k / n).alias(f"pct_state_{i}") for i, k in enumerate(counts)],
        *[k.alias(f"n_state_{i}") for i, k in enumerate(counts)],
        F.max_by("state", "unit").alias("final_state"), F.count_if(moved).alias("n_transitions"), F.count_if(c("state") > c("before")).alias("n_increases"), F.count_if(c("state") < c("before")).alias("n_decreases"),
        F.min(F.when(c("state") == n_states - 1, c("unit"))).alias("first_high_unit"), entropy.alias("entropy"), n.alias("n_units"), F.max("run").alias("max_run"),
        F.sum(lit(1.0) / c("run")).alias("runs"),
    )
    top = F.greatest(*[c(f"n_state_{i}") for i in range(n_states)])
    dominant = F.coalesce(*[F.when(c(f"n_state_{i}") == top, lit(i)) for i in range(n_states)])
    return out.select(
        "entity_id", *[f"pct_state_{i}" for i in range(n_states)], dominant.alias("dominant_state"), (top / c("n_units")).alias("pct_dominant_state"), "final_state", "n_transitions",
        F.when(c("n_units") > 1, c("n_transitions") / (c("n_units") - 1)).otherwise(0.0).alias("transition_rate"), "n_increases", "n_decreases", "first_high_unit", c("first_high_unit").isNotNull().alias("reached_high_state"),
        "entropy", (c("entropy") / math.log2(n_states)).alias("entropy_normalized"), (c("n_units") / F.round("runs")).alias("mean_run"), "max_run", F.round("runs").cast("long").alias("n_runs"),
    )


def transitions(seq: DataFrame, n_states: int = 3) -> DataFrame:
    """(state, next, n, p) pooled over entities for every pair of states; p is 0 where a state is never left."""
    following = F.lead("state").over(Window.partitionBy("entity_id").orderBy("unit"))
    pairs = seq.withColumn("next", following).where("next IS NOT NULL").groupBy("state", "next").agg(F.count("*").alias("n"))
    spark = seq.sparkSession
    grid = spark.createDataFrame([(i, j) for i in range(n_states) for j in range(n_states)], "state int, next int")
    full = grid.join(pairs, ["state", "next"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("state"))
    return full.select("state", "next", "n", F.when(total > 0, c("n") / total).otherwise(0.0).alias("p"))


def state_label(state: Column, n_states: int) -> Column:
    words = {3: ("Low", "Medium", "High"), 2: ("Low", "High")}.get(n_states)
    return F.get(F.array(*map(lit, words)), state) if words else F.concat(lit("State_"), state.cast("string"))


def state_table(events: DataFrame, resolution: str = "weekly", max_days: int = 365, n_states: int = 3, method: str = "burden_level") -> DataFrame:
    """The state features of all entities, from events in one call."""
    units = unit_burden(events, resolution)
    cuts = thresholds(units, n_states, method, resolution)
    return state_features(states(units, cuts, n_timepoints(resolution, max_days)), n_states)
