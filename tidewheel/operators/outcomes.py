"""Outcomes by group: rates, changes, prevalences before and after, and the summary of several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c, lit = F.col, F.lit


def event_rates(df: DataFrame, count: str, group: str) -> DataFrame:
    """(group, n, n_events, rate_pct): entities with a count of one or more; a missing count is none."""
    hit = F.coalesce(c(count) >= 1, lit(False))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_events"), (100.0 * F.count_if(hit) / F.count("*")).alias("rate_pct"))


def change_summary(df: DataFrame, before: str, after: str, group: str) -> DataFrame:
    """(group, n, mean_change, sd, pct_improved) of after - before, where both are known."""
    d = c("_d")
    known = df.withColumn("_d", c(after) - c(before)).where("_d IS NOT NULL")
    return known.groupBy(group).agg(F.count("*").alias("n"), F.avg(d).alias("mean_change"), F.stddev_samp(d).alias("sd"), (100.0 * F.avg((d > 0).cast("int"))).alias("pct_improved"))


def prevalences(df: DataFrame, pairs: dict[str, tuple[str, str]], group: str) -> DataFrame:
    """(label, group, before_pct, after_pct, change) of flags equal to 1, for every group and, where ``overall`` is true, for all rows; one pass by rollup."""
    have = {n: p for n, p in pairs.items() if p[0] in df.columns and p[1] in df.columns}
    pct = lambda x: 100.0 * F.count_if(c(x) == 1) / F.count("*")
    cells = [F.struct(lit(n).alias("label"), pct(a).alias("before_pct"), pct(b).alias("after_pct")) for n, (a, b) in have.items()]
    wide = df.rollup(group).agg(F.array(*cells).alias("s"), F.grouping(group).alias("overall"))
    long = wide.select(group, (c("overall") == 1).alias("overall"), F.inline("s"))
    return long.select("label", group, "overall", "before_pct", "after_pct", (c("after_pct") - c("before_pct")).alias("change"))


def summary(groups: DataFrame, tables: list[tuple[DataFrame, dict[str, str]]], by: str, key: str = "entity_id") -> DataFrame:
    """(group, n, means...): the size of each group and the mean of the wanted columns {column: name} of each table, joined by id.

    Every table is averaged by itself, so one with several rows an entity weighs them as they are.
    """
    out = groups.where(c(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    parts = []
    for table, columns in tables:
        have = {x: n for x, n in columns.items() if x in table.columns}
        if have:
            own = groups.select(key, by).join(table.select(key, *have), key).groupBy(by).agg(*[F.avg(c(x)).alias(n) for x, n in have.items()])
            parts.append(own)
    return reduce(lambda a, b: a.join(b, by, "left"), parts, out)
