"""Which features tell groups apart: tests, forests, mutual information, and their combination.

Tables here have a row for each feature.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.special import chi2_pvalue, f_pvalue
from tidewheel.operators.integration import column_stats
from tidewheel.operators.shared import save
from tidewheel.operators.stats import average_ranks, centred, quantiles, running_counts, running_sums

c, lit = F.col, F.lit
SEED = 42
#: Shares of known values below which a feature is skipped; bins of mutual information.
LEAST_KNOWN, BINS = 0.5, 10


def _long(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    number = lambda x: F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")).alias(x)
    return df.select(c(group).alias("g"), *map(number, columns)).unpivot(["g"], columns, "feature", "v")


def f_scores(df: DataFrame, group: str, columns: list[str], least_known: float = 0.0) -> DataFrame:
    """(feature, f_score, p_value) of one-way ANOVA over groups of two or more values; features with too many missing values have no row."""
    cells = _long(df, group, columns).groupBy("feature", "g").agg(F.count("*").alias("rows"), F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    known = cells.groupBy("feature").agg((F.sum("n") / F.sum("rows")).alias("share")).where(c("share") >= least_known).select("feature")
    used = cells.where("g IS NOT NULL AND n > 1").join(F.broadcast(known), "feature", "left_semi")
    t = centred(used, ("feature",)).groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(c("n") * c("s")).alias("w"), F.sum(c("n") * c("m") ** 2).alias("between"))
    f = (c("between") / (c("k") - 1)) / F.nullif(c("w") / (c("n") - c("k")), lit(0.0))
    out = t.where("k > 1 AND n > k").select("feature", f.alias("f_score"), (c("k") - 1).cast("double").alias("d1"), (c("n") - c("k")).cast("double").alias("d2"))
    return out.select("feature", "f_score", f_pvalue("f_score", "d1", "d2").alias("p_value"))


def kruskal_scores(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(feature, h, p_value): Kruskal-Wallis for every feature at once."""
    cells = _long(df, group, columns).where("v IS NOT NULL AND g IS NOT NULL").groupBy("feature", "g", "v").agg(F.count("*").alias("w"))
    cells = save(cells, "cells")  # ranks meet the rows that they were taken from, as in outcome_correlations
    ranked = cells.join(average_ranks(cells, "v", ("feature",), c("w")), ["feature", "v"])
    g = ranked.groupBy("feature", "g").agg(F.sum("w").alias("n"), F.sum(c("w") * c("rank")).alias("r"), F.sum(c("w") * (c("ties") * c("ties") - 1)).alias("tie"))
    g = g.withColumn("m", c("r") / c("n") - (F.sum("n").over(Window.partitionBy("feature")) + 1) / 2)  # from the mean rank of all; a row for each feature and group
    s = g.groupBy("feature").agg(F.sum("n").cast("double").alias("n"), F.count("*").alias("k"), F.sum(c("n") * c("m") ** 2).alias("q"), F.sum("tie").alias("tie")).where("k > 1")
    h = 12 / (c("n") * (c("n") + 1)) * c("q") / F.nullif(1 - c("tie") / (c("n") * (c("n") ** 2 - 1)), lit(0.0))
    return s.select("feature", h.alias("h"), (c("k") - 1).cast("double").alias("dof")).select("feature", "h", chi2_pvalue("h", "dof").alias("p_value"))


def mutual_information(df: DataFrame, group: str, columns: list[str], bins: int = BINS) -> DataFrame:
    """(feature, mi_score) in nats between a group and a feature cut at its even percentiles: an approximation that needs no neighbours."""
    long = _long(df, group, columns).where("v IS NOT NULL AND g IS NOT NULL")
    cuts = quantiles(long, "v", tuple(i / bins for i in range(1, bins)), ("feature",))
    binned = long.join(F.broadcast(cuts), "feature").withColumn("b", F.size(F.filter("p", lambda x: x < c("v"))))
    cells = binned.groupBy("feature", "g", "b").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))  # noqa: E731  a row for each cell
    each = cells.select("feature", "n", total().alias("t"), total("g").alias("ng"), total("b").alias("nb"))
    return each.groupBy("feature").agg(F.sum(c("n") / c("t") * F.ln(c("n") * c("t") / (c("ng") * c("nb")))).alias("mi_score"))


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1: sums below 16, the asymptotic series from there."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(lit(1), F.greatest(lit(1), F.least(n, lit(16)).cast("int"))), lit(0.0), lambda s, j: s + F.when(j < n, 1 / j).otherwise(0.0)) - 0.5772156649015329
    return F.when(n < 16, small).otherwise(F.ln(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


#: Parameter: rows of a class that one window of neighbours holds.
CHUNK = 1 << 16


def neighbour_information(df: DataFrame, group: str, columns: list[str], k: int = 3) -> DataFrame:
    """(feature, mi_score) in nats between a group and a continuous feature by nearest neighbours; never below 0.

    For each row the distance to its k-th neighbour of the same class (fewer in a small class), and m, the rows of any class nearer
    than that, itself included, or equal if that distance is 0: psi(N) + mean psi(k) - mean psi(class size) - mean psi(m).  Rows of classes of one, and
    missing values, are left out; ties are not jittered.  The rows of a class are numbered through range partitions, and windows of neighbours hold
    a stretch of them and k rows at either end, so a large class is many tasks.
    """
    rows = save(_long(df, group, columns).where("v IS NOT NULL AND g IS NOT NULL").withColumn("r", F.monotonically_increasing_id()), "values")
    placed = running_counts(rows.select("feature", "g", F.struct("v", "r").alias("at")), "at", ("feature", "g")).select("feature", "g", c("at.v").alias("v"), c("before").alias("p"))
    sizes = rows.groupBy("feature", "g").agg(F.count("*").alias("n")).where("n > 1")
    own = placed.join(F.broadcast(sizes), ["feature", "g"]).withColumn("home", F.floor(c("p") / CHUNK))
    halo = F.array_distinct(F.array("home", F.floor((c("p") - k) / CHUNK), F.floor((c("p") + k) / CHUNK)))
    near = own.withColumn("chunk", F.explode(halo))
    w = Window.partitionBy("feature", "g", "chunk").orderBy("p")
    gaps = [F.abs(f(c("v"), j).over(w) - c("v")) for f in (F.lag, F.lead) for j in range(1, k + 1)]
    radius = F.sort_array(F.filter(F.array(*gaps), lambda d: d.isNotNull()))
    reach = near.withColumn("d", radius).where("chunk = home").withColumn("k", F.least(lit(k), c("n") - 1)).select("feature", "v", "n", "k", c("d")[c("k").cast("int") - 1].alias("d"))
    reach = save(reach, "reach")
    # How many values are below each end: ends enter the sorted values with weight 0.
    ends = reach.select("feature", F.explode(F.array(c("v") - c("d"), c("v") + c("d"))).alias("x"), lit(0).alias("w"))
    counted = running_sums(reach.select("feature", c("v").alias("x"), lit(1).alias("w")).union(ends), "x", {"w": F.sum("w")}, ("feature",))
    below = save(counted, "below")
    low = below.select("feature", c("x").alias("lo"), c("w_before").alias("lo_below"), c("w").alias("lo_own"))
    high = below.select("feature", c("x").alias("hi"), c("w_before").alias("hi_below"), c("w").alias("hi_own"))
    same = reach.groupBy("feature", "v", "n", "k", "d").agg(F.count("*").alias("rows")).withColumns({"lo": c("v") - c("d"), "hi": c("v") + c("d")})
    met = same.join(low, ["feature", "lo"]).join(high, ["feature", "hi"])
    m = F.when(c("d") == 0, c("lo_own")).otherwise(c("hi_below") - c("lo_below") - c("lo_own"))
    s = met.withColumn("m", m).groupBy("feature").agg(F.sum("rows").alias("total"), *[F.sum(c("rows") * digamma(c(x))).alias(f"psi_{x}") for x in ("k", "n", "m")])
    return s.select("feature", F.greatest(lit(0.0), digamma(c("total")) + (c("psi_k") - c("psi_n") - c("psi_m")) / c("total")).alias("mi_score"))


def forest_scores(df: DataFrame, label: str, columns: list[str], task: str = "classification", trees: int = 100) -> DataFrame:
    """(feature, importance) of a random forest on all rows with a label; missing values are medians."""
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task {task!r}")
    fill = {x: (v[1] or [0.0])[0] for x, v in column_stats(df, columns, (0.5,)).items()}
    own = df.where(c(label).isNotNull()).select(label, *[F.coalesce(F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")), lit(fill[x])).alias(x) for x in columns])
    data = VectorAssembler(inputCols=columns, outputCol="v").transform(own)
    if task == "classification":
        data = StringIndexer(inputCol="y", outputCol="label").fit(t := data.withColumn("y", c(label).cast("string"))).transform(t)
        fit = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, seed=SEED).fit(data)
    else:
        fit = RandomForestRegressor(featuresCol="v", labelCol=label, numTrees=trees, seed=SEED).fit(data)
    return df.sparkSession.createDataFrame(list(zip(columns, fit.featureImportances.toArray().tolist(), strict=True)), "feature string, importance double")


def ranked(scores: DataFrame, by: str, name: str) -> DataFrame:
    """Add ``name``: 1 for the largest score, ties by feature.  The table has a row for each feature."""
    return scores.withColumn(name, F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "feature")))


def discriminating(df: DataFrame, group: str, columns: list[str], top: int = 20) -> DataFrame:
    """(feature, f_score, p_value, rf_importance, rank_anova, rank_rf, mean_rank) of the ``top`` features by mean rank."""
    both = f_scores(df, group, columns, LEAST_KNOWN).join(forest_scores(df, group, columns).withColumnRenamed("importance", "rf_importance"), "feature", "left")
    out = ranked(ranked(both, "f_score", "rank_anova"), "rf_importance", "rank_rf")
    return out.withColumn("mean_rank", (c("rank_anova") + c("rank_rf")) / 2).orderBy("mean_rank", "feature").limit(top)


def combined(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(feature, rf, f, mi, combined_score): each score over its largest, and their mean."""
    scores = [forest_scores(df, group, columns, trees=200).withColumnRenamed("importance", "rf"), f_scores(df, group, columns).select("feature", F.coalesce("f_score", lit(0.0)).alias("f")), mutual_information(df, group, columns).withColumnRenamed("mi_score", "mi")]
    all_ = scores[0].join(scores[1], "feature").join(scores[2], "feature")
    share = lambda x: c(x) / F.nullif(F.max(x).over(Window.partitionBy(lit(0))), lit(0.0))  # noqa: E731  a row for each feature
    return all_.withColumns({f"{x}_norm": share(x) for x in ("rf", "f", "mi")}).withColumn("combined_score", (c("rf_norm") + c("f_norm") + c("mi_norm")) / 3).orderBy(F.desc("combined_score"), "feature")


def representatives(scores: list[tuple[str, float]], clusters: dict[str, int], core: list[str], more: int = 10) -> list[str]:
    """Core features, then the best of each cluster that has none yet, then the best of all, ``more`` in total beside the core."""
    rest = [f for f, _ in sorted(scores, key=lambda x: (-x[1], x[0])) if f not in core]
    chosen, seen = list(core), {clusters[f] for f in core if f in clusters}
    for f in rest:
        if len(chosen) < len(core) + more and clusters[f] not in seen:
            chosen.append(f)
            seen.add(clusters[f])
    return chosen + [f for f in rest if f not in chosen][: max(0, len(core) + more - len(chosen))]


#: The score columns of the methods, in the order in which they are looked for, and their names.
KINDS = (("mean_abs_shap", "shap"), ("importance_mean", "permutation"), ("importance", "rf"))


def top(scores: DataFrame, n: int = 15) -> DataFrame:
    """(feature, <method>_importance) of the n largest of the first score column that is there."""
    for column, name in KINDS:
        if column in scores.columns:
            return scores.orderBy(F.desc_nulls_last(column), "feature").limit(n).select("feature", c(column).alias(f"{name}_importance"))
    raise ValueError("no column of scores is known")


def importance_report(methods: dict, n: int = 15) -> dict[str, DataFrame | str]:
    """The top features of every method (name: a function that returns its scores), or the text of its error."""
    out: dict[str, DataFrame | str] = {}
    for name, scores in methods.items():
        try:
            out[name] = top(scores(), n)
        except Exception as e:  # noqa: BLE001  one method's failure is a line of the report
            out[name] = f"{type(e).__name__}: {e}"
    return out


def group_table(df: DataFrame, group: str, features: dict[str, str]) -> DataFrame:
    """(feature, description, means map, p_value, importance): the mean of each group, Kruskal-Wallis, and F over the largest F; strongest first."""
    columns = [x for x in features if x in df.columns]
    df = save(df.select(*dict.fromkeys([group, *columns])), "rows")  # medians, means, ranks and scores read the same values
    fill = {x: (v[1] or [None])[0] for x, v in column_stats(df, columns, (0.5,)).items()}
    full = df.select(group, *[F.coalesce(c(x).cast("double"), lit(fill[x])).alias(x) for x in columns])
    means = _long(df, group, columns).where("g IS NOT NULL").groupBy("feature", "g").agg(F.avg("v").alias("m"))
    cells = means.groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c("g").cast("string").alias("g"), F.format_string("%.1f", "m").alias("m"))))).alias("means"))
    out = cells.join(kruskal_scores(df, group, columns).select("feature", "p_value"), "feature", "left").join(f_scores(full, group, columns).select("feature", "f_score"), "feature", "left")
    about = F.create_map(*[lit(x) for pair in features.items() for x in pair])
    share = F.coalesce(c("f_score"), lit(0.0)) / F.nullif(F.max("f_score").over(Window.partitionBy(lit(0))), lit(0.0))
    return out.select("feature", about[c("feature")].alias("description"), "means", "p_value", F.coalesce(share, lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
