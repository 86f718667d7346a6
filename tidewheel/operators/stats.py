"""Hypothesis tests, correlations with outcomes and the comparison table, from sums and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.special import chi2_pvalue, f_pvalue, t_pvalue
from tidewheel.operators.shared import save

c, lit = F.col, F.lit


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: statistic, dof, p_value of independence; Yates' correction for a 2 x 2 table."""
    cells = df.where(c(a).isNotNull() & c(b).isNotNull()).groupBy(c(a).alias("a"), c(b).alias("b")).agg(F.count("*").alias("n"))
    # The table has a row for each pair of values: margins are windows over it.
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    grid = rows.join(F.broadcast(cols)).join(F.broadcast(total)).join(cells, ["a", "b"], "left").na.fill(0, ["n"])
    expected = c("ra") * c("cb") / c("t")
    dof = (c("na") - 1) * (c("nb") - 1)
    gap = F.abs(c("n") - expected)
    gap = F.when(dof == 1, gap - F.least(lit(0.5), gap)).otherwise(gap)
    out = grid.agg(F.sum(gap * gap / expected).alias("statistic"), F.max(dof).alias("dof"), F.max("t").alias("n"))
    return out.select("statistic", "dof", "n", chi2_pvalue("statistic", c("dof").cast("double")).alias("p_value"))


def centred(groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means ``m`` of groups of ``n`` rows, less the mean of all, so that sums of their squares lose no digits.  The table has a row for each group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(lit(0))
    return groups.withColumn("m", c("m") - F.sum(c("n") * c("m")).over(w) / F.sum("n").over(w))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F statistic, degrees of freedom, p_value of equal means."""
    g = df.where(c(value).isNotNull() & c(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = centred(g).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(c("n") * c("v")).alias("within"), F.sum(c("n") * c("m") ** 2).alias("between"))
    f = (c("between") / (c("k") - 1)) / F.nullif(c("within") / (c("n") - c("k")), lit(0.0))
    out = s.where("k > 1 AND n > k").select(f.alias("statistic"), (c("k") - 1).alias("dof1"), (c("n") - c("k")).alias("dof2"))
    return out.select("*", f_pvalue("statistic", c("dof1").cast("double"), c("dof2").cast("double")).alias("p_value"))


def running_sums(df: DataFrame, value: str, sums: dict[str, Column], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """(by, value, <name>, <name>_before): aggregates of each known value within ``by``, and their sums over the smaller values (or larger, if descending).

    Values are aggregated first and numbered through range partitions of (by, value), so no task sees all of
    a group; the sums of partitions, few rows, are added up by a window.  The aggregates are written to the
    shared folder, so both readers see the same ranges whatever executors are lost.
    """
    side = F.desc(value) if descending else F.asc(value)
    cells = df.where(c(value).isNotNull()).groupBy(*by, value).agg(*[e.alias(n) for n, e in sums.items()])
    parts = save(cells.repartitionByRange(*by, side).withColumn("_p", F.spark_partition_id()), "sums")
    whole = parts.groupBy(*by, "_p").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*[c(x).alias(f"_k_{x}") for x in by], c("_p").alias("_q"), *[F.coalesce(F.sum(f"_s_{n}").over(upto), lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy("_p", *by).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({f"_i_{n}": F.coalesce(F.sum(n).over(inner), lit(0)) for n in sums})
    joined = own.join(starts, [c(x).eqNullSafe(c(f"_k_{x}")) for x in by] + [c("_p") == c("_q")])
    return joined.select(*by, value, *[x for n in sums for x in (c(n), (c(f"_b_{n}") + c(f"_i_{n}")).alias(f"{n}_before"))])


def running_counts(df: DataFrame, value: str, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by, value, k, before): rows with each known value, and with smaller ones, within ``by``."""
    return running_sums(df, value, {"k": F.count("*") if weight is None else F.sum(weight)}, by).withColumnRenamed("k_before", "before")


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, p array): exact percentiles with linear interpolation; groups without a known value have no row."""
    ranked = running_counts(df, value, by)
    sized = ranked.groupBy(*by).agg(F.sum("k").alias("_n"))
    same = [c(x).eqNullSafe(c(f"_{x}")) for x in by]
    sized = sized.withColumnsRenamed({x: f"_{x}" for x in by})
    ranked = ranked.join(F.broadcast(sized), same) if by else ranked.join(F.broadcast(sized))  # a row for each group
    place = [(c("_n") - 1) * lit(float(q)) for q in shares]
    at = lambda i: F.max(F.when((c("before") <= i) & (i < c("before") + c("k")), c(value).cast("double")))
    ends = [x for i, h in enumerate(place) for x in (at(F.floor(h)).alias(f"_a{i}"), at(F.ceil(h)).alias(f"_b{i}"))]
    found = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    return found.select(*by, F.array(*[c(f"_a{i}") + (c(f"_b{i}") - c(f"_a{i}")) * (h - F.floor(h)) for i, h in enumerate(place)]).alias("p"))


def average_ranks(df: DataFrame, value: str, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by, value, ties, rank): the average rank of each known value within ``by``."""
    return running_counts(df, value, by, weight).select(*by, value, c("k").alias("ties"), (c("before") + (c("k") + 1) / 2).alias("rank"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: tie-corrected H, dof, p_value.  Ranks come from a histogram of the distinct values, which meets the counts of (group, value)."""
    own = df.where(c(value).isNotNull() & c(group).isNotNull()).groupBy(c(group).alias("g"), c(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    own = save(own, "cells")  # as in outcome_correlations
    ranked = own.join(average_ranks(own, "v", (), c("w")), "v")
    g = ranked.groupBy("g").agg(F.sum("w").alias("n"), F.sum(c("w") * c("rank")).alias("r"), F.sum(c("w") * (c("ties") * c("ties") - 1)).alias("tie"))
    # The mean rank of all is (n + 1) / 2: squares of what groups differ from it keep their digits where those of ranks are large.
    g = g.withColumn("m", c("r") / c("n") - (F.sum("n").over(Window.partitionBy(lit(0))) + 1) / 2)  # a row for each group
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(c("n") * c("m") ** 2).alias("q"), F.sum("tie").alias("tie"))
    h = 12 / (c("n").cast("double") * (c("n") + 1)) * c("q")
    # Each value of a tie of size t adds t^2 - 1, so a tie adds t^3 - t.
    n3 = c("n").cast("double") * (c("n").cast("double") ** 2 - 1)
    out = s.where("k > 1").select((h / F.nullif(1 - c("tie") / n3, lit(0.0))).alias("statistic"), (c("k") - 1).alias("dof"))
    return out.select("statistic", "dof", chi2_pvalue("statistic", c("dof").cast("double")).alias("p_value"))


def compare(df: DataFrame, outcome: str, group: str, test: str = "auto") -> DataFrame:
    """The test of an outcome over groups: chi-square for at most two distinct values, else Kruskal-Wallis; or the named one."""
    if test == "auto":
        test = "chi2" if df.select(F.count_distinct(outcome).alias("n")).first()["n"] <= 2 else "kruskal"
    if test not in ("chi2", "anova", "kruskal"):
        raise ValueError(f"unknown test {test!r}")
    found = chi_square(df, outcome, group) if test == "chi2" else anova(df, outcome, group) if test == "anova" else kruskal(df, outcome, group)
    return found.select(lit(test).alias("test"), "statistic", "p_value")


def outcome_correlations(df: DataFrame, features: list[str], outcome: str, method: str = "pearson", key: str = "entity_id") -> DataFrame:
    """(feature, r, n, p_value, significant) over complete pairs, n >= 10, strongest first."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    long = df.select(key, c(outcome).cast("double").alias("y"), *[c(x).cast("double").alias(x) for x in features]).unpivot([key, "y"], features, "feature", "x").where("x IS NOT NULL AND y IS NOT NULL")
    # Equal pairs are one row, so that a frequent value is no hot key of the joins with ranks.
    cells, x, y = long.groupBy("feature", "x", "y").agg(F.count("*").alias("w")), c("x"), c("y")
    if method == "spearman":
        # Ranks meet the rows that they were taken from: an average made again may differ in its last bit and would find no rank.
        cells = save(cells, "cells")
        for v in "xy":
            cells = cells.join(average_ranks(cells, v, ("feature",), c("w")).drop("ties").withColumnRenamed("rank", f"r{v}"), ["feature", v])
        x, y = c("rx"), c("ry")
    means = cells.groupBy("feature").agg((F.sum(c("w") * x) / F.sum("w")).alias("mx"), (F.sum(c("w") * y) / F.sum("w")).alias("my"))
    u, v = x - c("mx"), y - c("my")
    sums = cells.join(F.broadcast(means), "feature").groupBy("feature").agg(F.sum("w").alias("n"), F.sum(c("w") * u * v).alias("uv"), F.sum(c("w") * u * u).alias("uu"), F.sum(c("w") * v * v).alias("vv"))
    g = sums.where("n >= 10").select("feature", "n", (c("uv") / F.nullif(F.sqrt(c("uu") * c("vv")), lit(0.0))).alias("r"))
    t = c("r") * F.sqrt((c("n") - 2) / F.nullif(1 - c("r") ** 2, lit(0.0)))
    return g.select("feature", "r", "n", t_pvalue(t, (c("n") - 2).cast("double")).alias("p_value")).withColumn("significant", c("p_value") < 0.05).orderBy(F.abs("r").desc_nulls_last(), "feature")


def format_p(p: Column) -> Column:
    return F.when(p.isNull(), "N/A").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def outcome_table(df: DataFrame, outcomes: list[str], group: str) -> DataFrame:
    """(group, outcome, kind, n, events, rate, mean, sd, median): an outcome of at most two values 0/1 is binary for all groups."""
    kinds = df.agg(*[(F.count_if(c(x).isNotNull() & ~c(x).isin(0, 1)) == 0).alias(x) for x in outcomes]).first()
    long = df.select(group, *[c(x).cast("double").alias(x) for x in outcomes]).unpivot([group], outcomes, "outcome", "v")
    binary = c("outcome").isin([x for x in outcomes if kinds[x]] or [""])
    g = long.groupBy(group, "outcome").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    middle = quantiles(long, "v", (0.5,), (group, "outcome")).select(c(group).alias("_g"), c("outcome").alias("_o"), F.get("p", lit(0)).alias("median"))
    g = g.join(middle, c(group).eqNullSafe(c("_g")) & (c("outcome") == c("_o")), "left")
    return g.select(group, "outcome", F.when(binary, "binary").otherwise("continuous").alias("kind"), "n", F.when(binary, c("s")).alias("events"), F.when(binary, c("m")).alias("rate"), F.when(~binary, c("m")).alias("mean"), F.when(~binary, c("sd")).alias("sd"), F.when(~binary, c("median")).alias("median"))


def analysis_table(df: DataFrame, variables: dict[str, str], group: str, categorical: tuple[str, ...] = ()) -> DataFrame:
    """(label, n, overall, <one column for each group>, p_value), formatted.

    Continuous: "mean (sd)" and Kruskal-Wallis; binary: per cent of the higher
    value; other categories: the most frequent value, the smallest on a tie; both with
    chi-square.  A variable with at most five distinct numbers is categorical.
    """
    spark = df.sparkSession
    have = [x for x in variables if x in df.columns]
    distinct = df.agg(*[F.count_distinct(x).alias(x) for x in have]).first()
    groups = [r[0] for r in df.where(c(group).isNotNull()).select(group).distinct().orderBy(group).collect()]  # phenotypes are few
    names = ["overall", *[f"P{g}" for g in groups]]
    rows = []
    texts = {x for x, t in df.dtypes if t == "string"}
    for x in have:
        is_cat = x in categorical or x in texts or distinct[x] <= 5
        per = df.where(c(group).isNotNull()).groupBy(group).agg(*_cells(x, is_cat, distinct[x])).collect()
        total = df.agg(*_cells(x, is_cat, distinct[x])).first()
        high = df.agg(F.max(x)).first()[0] if is_cat and distinct[x] == 2 else None
        if high is not None:
            share = F.format_string("%.1f%%", 100 * F.avg((c(x) == lit(high)).cast("int"))).alias("cell")
            per, total = df.where(c(group).isNotNull()).groupBy(group).agg(share).collect(), df.agg(share).first()
        p = (chi_square(df, x, group) if is_cat else kruskal(df, x, group)).select("p_value").first()
        cells = {r[group]: r["cell"] for r in per}
        rows.append((variables[x], df.where(c(x).isNotNull()).count(), total["cell"], *[cells.get(g) for g in groups], p[0] if p else None))
    schema = "label string, n long, " + ", ".join(f"`{n}` string" for n in names) + ", p double"
    return spark.createDataFrame(rows, schema).withColumn("p_value", format_p(c("p")))


def _cells(x: str, is_cat: bool, distinct: int) -> list[Column]:
    if is_cat:
        return [F.mode(c(x).cast("string"), deterministic=True).alias("cell")]
    return [F.format_string("%.1f (%.1f)", F.avg(x), F.stddev_samp(x)).alias("cell")]
