"""Joining entity tables, cohorts, overlaps, missingness and descriptive tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewheel.operators.shared import save
from tidewheel.operators.stats import quantiles

c, lit = F.col, F.lit


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ("entity_id",)) -> list[str]:
    """Number columns but the ids; booleans are none."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def attach(left: DataFrame, right: DataFrame, columns: list[str] | None = None, key: str = "entity_id") -> DataFrame:
    """Left join of the wanted columns that ``right`` has; Spark picks the strategy by size."""
    have = [x for x in (columns if columns is not None else right.columns) if x in right.columns and x != key]
    return left.join(right.select(key, *have), key, "left")


def overlap(tables: dict[str, DataFrame], key: str = "entity_id") -> DataFrame:
    """One row: distinct ids of each table, of each pair, of all, and of each table alone."""
    names = list(tables)
    flags = [tables[n].where(c(key).isNotNull()).select(key).distinct().withColumn("_t", lit(i)) for i, n in enumerate(names)]
    union = flags[0]
    for f in flags[1:]:
        union = union.unionByName(f)
    seen = union.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1, _t)")).alias("m"))
    has = lambda mask: c("m").bitwiseAND(lit(mask)) == mask
    n = len(names)
    out = [F.count_if(has(1 << i)).alias(f"n_{x}") for i, x in enumerate(names)]
    out += [F.count_if(has(1 << i | 1 << j)).alias(f"n_{names[i]}_and_{names[j]}") for i in range(n) for j in range(i + 1, n)]
    out += [F.count_if(c("m") == 1 << i).alias(f"n_only_{x}") for i, x in enumerate(names)]
    return seen.agg(*out, F.count_if(has((1 << n) - 1)).alias("n_all"), F.count("*").alias("n_any"))


def missing_ids(left: DataFrame, right: DataFrame, key: str = "entity_id") -> DataFrame:
    """Distinct ids of ``left`` that ``right`` lacks."""
    return left.where(c(key).isNotNull()).select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, missing_in): distinct ids that only one of two tables has, in one exchange."""
    ids = lambda df, bit: df.where(c(key).isNotNull()).select(key, lit(bit).alias("_t"))
    seen = ids(left, 1).unionByName(ids(right, 2)).groupBy(key).agg(F.bit_or("_t").alias("_m"))
    return seen.where("_m < 3").select(key, F.when(c("_m") == 1, "right").otherwise("left").alias("missing_in"))


def cohort(events: DataFrame, outcomes: DataFrame, outcome: str, min_events: int = 1) -> tuple[DataFrame, DataFrame]:
    """Events of the entities with enough events and a known outcome, and the attrition table (step, n)."""
    every = events.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("n"))
    enough = every.where(c("n") >= min_events).select("entity_id")
    known = outcomes.where(c(outcome).isNotNull()).select("entity_id").distinct()
    kept = enough.join(known, "entity_id", "left_semi")
    steps = [("all", every), ("enough_events", enough), ("known_outcome", kept)]
    log = None
    for i, (name, df) in enumerate(steps):
        row = df.agg(lit(i).alias("step_no"), lit(name).alias("step"), F.count("*").alias("n"))
        log = row if log is None else log.unionByName(row)
    return events.join(kept, "entity_id", "left_semi"), log


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def unpivot(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """(keys, feature, value) with values as doubles."""
    return df.select(*keys, *[c(x).cast("double").alias(x) for x in columns]).unpivot(list(keys), columns, "feature", "value")


def missingness(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct_missing), most missing first, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(c(x).isNull()).alias(x) for x in df.columns])
    long = counts.unpivot(["_n"], df.columns, "column", "n_missing")
    return long.select("column", "n_missing", F.coalesce(100.0 * F.try_divide("n_missing", "_n"), lit(0.0)).alias("pct_missing")).orderBy(F.desc("pct_missing"), "column")


def describe(df: DataFrame, columns: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Per feature (and group): count, missing, mean, sd (n-1), quartiles, extremes."""
    columns = columns or numeric_columns(df)
    keys = (by,) if by else ()
    long = df.select(*keys, *[c(x).cast("double").alias(x) for x in columns]).unpivot(list(keys), columns, "feature", "value")
    out = long.groupBy(*keys, "feature").agg(F.count("value").alias("n"), F.count_if(c("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    named = quantiles(long, "value", (0.25, 0.5, 0.75), (*keys, "feature")).withColumnsRenamed({x: f"_{x}" for x in (*keys, "feature")})
    same = [c(x).eqNullSafe(c(f"_{x}")) for x in (*keys, "feature")]
    out = out.join(named, same, "left")
    quarter = [F.get("p", lit(i)).alias(x) for i, x in enumerate(("p25", "median", "p75"))]
    return out.select(*keys, "feature", "n", "n_missing", (100.0 * c("n_missing") / (c("n") + c("n_missing"))).alias("pct_missing"), "mean", "sd", "min", *quarter, "max")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct)."""
    counts = df.groupBy(c(column).alias("value")).agg(F.count("*").alias("n"))
    # One row per distinct value: the total is an aggregate of these.
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", (100.0 * c("n") / c("total")).alias("pct"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the pairs that occur."""
    return df.where(c(a).isNotNull() & c(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


# Feature matrices


def column_stats(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.01, 0.5, 0.99)) -> dict[str, tuple]:
    """Per column its missing share and percentiles (None without a finite value); what is collected has a row for each column."""
    number = lambda x: c(x).cast("double")
    finite = df.select(*[F.when(~F.isnan(number(x)) & (F.abs(number(x)) != float("inf")), number(x)).alias(x) for x in columns])
    row = finite.agg(*[F.avg(c(x).isNull().cast("int")).alias(x) for x in columns]).first()
    found = {r["feature"]: r["p"] for r in quantiles(finite.unpivot([], columns, "feature", "value"), "value", shares, ("feature",)).collect()}
    return {x: (row[x], found.get(x)) for x in columns}


def preprocess(df: DataFrame, columns: list[str] | None = None, most_missing: float = 0.2, key: str = "entity_id") -> DataFrame:
    """Screen columns by missing share, set inf to missing, fill in medians, clip to the 1st and 99th percentile, scale (population sd).

    Statistics are a row for each column: missing shares, percentiles of the columns and of the filled ones, means and sds, each an aggregate of its own.
    """
    columns = columns or numeric_columns(df, (key,))
    stats = column_stats(df, columns)
    kept = [x for x in columns if (stats[x][0] or 0) < most_missing]
    fill = lambda x: (stats[x][1] or [0.0, 0.0, 0.0])[1]
    filled = {x: F.coalesce(F.when(~F.isnan(c(x).cast("double")) & (F.abs(c(x).cast("double")) != float("inf")), c(x).cast("double")), lit(float(fill(x)))) for x in kept}
    dense = df.select(key, *[e.alias(x) for x, e in filled.items()])
    # Bounds are those of the filled column, as clipping comes after filling.
    edges = column_stats(dense, kept, (0.01, 0.99))
    clipped = dense.select(key, *[F.greatest(F.least(c(x), lit(float(edges[x][1][1]))), lit(float(edges[x][1][0]))).alias(x) for x in kept])
    row = clipped.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(x) for x in kept]).first()
    return clipped.select(key, *[((c(x) - lit(row[x]["m"])) / lit(row[x]["s"] or 1.0)).alias(x) for x in kept])


def correlations(df: DataFrame, columns: list[str], least: float = 0.8, key: str = "entity_id") -> DataFrame:
    """(a, b, r, n) of feature pairs with |r| >= least, pairwise complete, strongest first.

    Tasks add up counts, sums and products of all pairs in matrices, which are summed by pair: one pass, after one for
    the means, by which values are shifted.  The table of sums has a row for each pair and task.
    """
    p = len(columns)
    # Written once, so that the two passes do not derive the columns twice.
    numbers = save(df.select(*[F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")).alias(f"x{i}") for i, x in enumerate(columns)]), "numbers")
    row = numbers.agg(*[F.coalesce(F.avg(f"x{i}"), lit(0.0)).alias(f"x{i}") for i in range(p)]).first()
    means = np.array([row[f"x{i}"] for i in range(p)], dtype=float)
    i, j = np.triu_indices(p, 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, p, p))
        for b in batches:
            x = b.to_numpy(dtype=float) - means
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            for at, (u, v) in enumerate(((m, m), (x, m), (m, x), (x * x, m), (m, x * x), (x, x))):
                total[at] += u.T @ v
        yield pd.DataFrame({"i": i, "j": j} | {f"s{k}": total[k][i, j] for k in range(6)})

    parts = numbers.mapInPandas(sums, "i int, j int, " + ", ".join(f"s{k} double" for k in range(6)))
    s = parts.groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(x) for k, x in enumerate(("n", "x", "y", "xx", "yy", "xy"))])
    # Sums of squares that are only rounding belong to constant columns.
    spread = lambda q, v: F.when(c(q) - c(v) * c(v) / c("n") > 1e-14 * c(q), c(q) - c(v) * c(v) / c("n"))
    name = lambda x: F.element_at(F.array(*[lit(v) for v in columns]), c(x) + 1)
    r = (c("xy") - c("x") * c("y") / c("n")) / F.sqrt(spread("xx", "x") * spread("yy", "y"))
    out = s.select(name("i").alias("a"), name("j").alias("b"), F.when(r.isNotNull(), F.greatest(lit(-1.0), F.least(lit(1.0), r))).alias("r"), c("n").cast("long").alias("n"))
    return out.where(F.abs("r") >= least).orderBy(F.abs("r").desc(), "a", "b")


def select_features(df: DataFrame, method: str = "all", columns: list[str] | None = None, n: int | None = None, curated: tuple[str, ...] = ()) -> list[str]:
    """Names by ``all``, ``curated``, ``variance`` (variance over squared mean above 0.01) or ``correlation`` (drop later ones with |r| > 0.8)."""
    columns = columns or numeric_columns(df)
    if method == "all":
        found = columns
    elif method == "curated":
        found = [x for x in curated if x in df.columns]
    elif method == "variance":
        row = df.agg(*[(F.var_samp(x) / (F.avg(x) ** 2 + 1e-10)).alias(x) for x in columns]).first()
        found = [x for x in columns if row[x] is not None and row[x] > 0.01]
    elif method == "correlation":
        close = {(r["a"], r["b"]) for r in correlations(df, columns, 0.8).where(F.abs("r") > 0.8).collect()}
        found = []
        for x in columns:
            if not any((y, x) in close for y in found):
                found.append(x)
    else:
        raise ValueError(f"unknown selection {method!r}")
    return found[:n] if n else found


def profile(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(group, feature, n, mean, sd, z, scaled): means per group, their z-score over groups and 0..1 scaling."""
    long = df.select(by, *[c(x).cast("double").alias(x) for x in columns]).unpivot([by], columns, "feature", "value")
    means = long.groupBy(by, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    w = Window.partitionBy("feature")
    sd, low, high = F.stddev_samp("mean").over(w), F.min("mean").over(w), F.max("mean").over(w)
    return means.select("*", ((c("mean") - F.avg("mean").over(w)) / F.nullif(sd, lit(0.0))).alias("z"), ((c("mean") - low) / F.nullif(high - low, lit(0.0))).alias("scaled"))


def winsorise(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    edges = column_stats(df, columns, (low, high))
    return df.withColumns({x: F.when(c(x).isNotNull(), F.greatest(F.least(c(x), lit(edges[x][1][1])), lit(edges[x][1][0]))) for x in columns if edges[x][1]})


def null_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their plausible range become missing."""
    return df.withColumns({x: F.when(c(x).between(*b), c(x)) for x, b in bounds.items() if x in df.columns})


def body_surface(height_cm: Column, weight_kg: Column) -> Column:
    return 0.007184 * F.pow(height_cm, lit(0.725)) * F.pow(weight_kg, lit(0.425))


def changes(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add after - before for every named pair of columns (before, after) that is there."""
    return df.withColumns({n: c(b) - c(a) for n, (a, b) in pairs.items() if a in df.columns and b in df.columns})


def normal_id(column: Column) -> Column:
    """An id written as text or number, with or without ``.0``, as a bigint; NULL if it is none."""
    return F.regexp_replace(F.trim(column.cast("string")), r"\.0$", "").try_cast("bigint")


def recode(column: Column, codes: dict, otherwise=None) -> Column:
    """A value for each code; other values, and missing ones, get ``otherwise``."""
    table = F.create_map(*[lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), lit(otherwise)) if otherwise is not None else F.try_element_at(table, column)


def flag(column: Column, code) -> Column:
    """1 where the column has the code, else 0, also where it is missing."""
    return F.coalesce((column == lit(code)).cast("int"), lit(0))


def indexed(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Add numerator / denominator for every named pair (numerator, denominator) that is there; NULL where the denominator is 0."""
    return df.withColumns({n: F.try_divide(c(a).cast("double"), c(b).cast("double")) for n, (a, b) in ratios.items() if a in df.columns and b in df.columns})


def looked_up(df: DataFrame, column: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the value of a small table by key; NULL without one.  Spark broadcasts it if it is small."""
    return df.join(table.select(c(key).alias("_k"), c(value).alias(name)), c(column) == c("_k"), "left").drop("_k")
