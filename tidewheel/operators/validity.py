"""Cluster validity, agreement and representatives.

Points come as (entity_id, cluster, features array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.neighbours import indexed, sums_by_cluster
from tidewheel.operators.shared import save

c, lit = F.col, F.lit
NOISE = -1


def _sq(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lit(0.0), lambda s, x: s + x)


def centroids(points: DataFrame) -> DataFrame:
    """(cluster, n, center array) by one aggregate over positions."""
    long = points.select("cluster", F.posexplode("features").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return long.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))


def within_between(points: DataFrame) -> DataFrame:
    """One row: n, k, sum of squares within and between clusters; noise is left out."""
    own = points.where(c("cluster") != NOISE)
    long = own.select("cluster", F.posexplode("features").alias("pos", "x")).groupBy("cluster", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    by_pos = long.groupBy("pos").agg(F.sum(c("n") * c("v")).alias("w"), (F.sum(c("n") * c("m") ** 2) - F.sum(c("n") * c("m")) ** 2 / F.sum("n")).alias("b"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return by_pos.agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum("w").alias("within"), F.sum("b").alias("between"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    s = within_between(points)
    ch = (c("between") / (c("k") - 1)) / F.nullif(c("within") / (c("n") - c("k")), lit(0.0))
    return s.select(F.when((c("k") >= 2) & (c("n") > c("k")), ch).otherwise(0.0).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    own = points.where(c("cluster") != NOISE)
    cs = centroids(own)
    spread = own.join(F.broadcast(cs), "cluster").groupBy("cluster").agg(F.avg(F.sqrt(_sq("features", "center"))).alias("s"), F.first("center").alias("center"))
    a, b = (spread.select(*[c(x).alias(f"{x}_{n}") for x in spread.columns]) for n in "ab")
    pair = a.join(F.broadcast(b), c("cluster_a") != c("cluster_b"))  # clusters are few
    worst = pair.groupBy("cluster_a").agg(F.max((c("s_a") + c("s_b")) / F.nullif(F.sqrt(_sq("center_a", "center_b")), lit(0.0))).alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), lit(float("inf"))).alias("davies_bouldin"))


def silhouettes(points: DataFrame) -> DataFrame:
    """(entity_id, cluster, silhouette) with Euclidean distances; 0 for noise and single points."""
    return silhouettes_by(points, ("cluster",)).select("entity_id", "cluster", F.get("silhouettes", lit(0)).alias("silhouette"))


def silhouettes_by(points: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """The points (entity_id, features, <labels>), with ``silhouettes``: an array of one for each label.

    Every point is compared with all points, as the measure asks for: blocks of points meet blocks, and give
    sums per (point, label, cluster), which are combined before the shuffle.  Points that are equal, clusters included, have equal silhouettes, so they are one row with a weight.
    """
    known = c("entity_id").isNotNull() & c("features").isNotNull() & F.greatest(*[c(x) != NOISE for x in labels], lit(False))
    own = [F.when(c(x) != NOISE, c(x)).alias(x) for x in labels]
    kept = save(points.where(known).select("entity_id", c("features").cast("array<double>").alias("features"), *own).dropDuplicates(["entity_id"]), "points")
    classes = save(kept.groupBy("features", *labels).agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("weight")), "classes")
    rows = save(indexed(classes).join(classes.select("entity_id", *labels, "weight"), "entity_id").select("entity_id", "i", "x", *labels, "weight"), "points")
    homes = rows.select("i", F.posexplode(F.array(*[c(x).cast("int") for x in labels])).alias("of", "home"))
    means = sums_by_cluster(rows, labels).join(homes, ["i", "of"]).withColumn("m", c("d") / c("n"))
    ab = means.groupBy("i", "of").agg(F.max(F.when(c("to") == c("home"), c("m"))).alias("a"), F.min(F.when(c("to") != c("home"), c("m"))).alias("b"))
    s = F.when(c("a").isNull() | c("b").isNull(), 0.0).otherwise((c("b") - c("a")) / F.nullif(F.greatest("a", "b"), lit(0.0)))
    found = ab.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("of", F.coalesce(s, lit(0.0)).alias("v")))).alias("v"))  # an entry for each label
    of_class = rows.join(found, "i").select(c("x").alias("features"), *labels, "v")
    same = [kept["features"] == of_class["features"]] + [kept[x].eqNullSafe(of_class[x]) for x in labels]
    each = kept.join(of_class, same).select(kept["entity_id"], "v")
    value = [F.when(c(x) == NOISE, 0.0).otherwise(F.coalesce(F.element_at("v", lit(of)), lit(0.0))) for of, x in enumerate(labels)]
    return points.join(each, "entity_id", "left").select(*[points[x] for x in points.columns], F.array(*value).alias("silhouettes"))


def silhouette(points: DataFrame) -> DataFrame:
    own = silhouettes(points).where(c("cluster") != NOISE)
    return own.agg(F.when(F.count_distinct("cluster") >= 2, F.avg("silhouette")).otherwise(0.0).alias("silhouette"))


def sizes(points: DataFrame) -> DataFrame:
    counts = points.groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.select("cluster", "n", (100.0 * c("n") / F.sum("n").over(Window.partitionBy(lit(0)))).alias("pct"))


def summary(points: DataFrame, names: list[str]) -> DataFrame:
    """(cluster, n, pct, <name>_mean, <name>_std): the size of each cluster, and the mean and sample sd of every feature."""
    stats = [e for i, x in enumerate(names) for e in (F.avg(F.get("features", lit(i))).alias(f"{x}_mean"), F.stddev_samp(F.get("features", lit(i))).alias(f"{x}_std"))]
    out = points.groupBy("cluster").agg(F.count("*").alias("n"), *stats)
    # A row for each cluster.
    return out.withColumn("pct", 100.0 * c("n") / F.sum("n").over(Window.partitionBy(lit(0)))).select("cluster", "n", "pct", *[f"{x}_{k}" for x in names for k in ("mean", "std")])


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings."""
    cells = labels.groupBy(c(a).alias("a"), c(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    two = lambda x: x * (x - 1) / 2
    ent = lambda x: F.sum(x * F.ln(x))
    s = cells.agg(F.sum("n").alias("n"), F.sum(two(c("n"))).alias("pairs"), ent(c("n")).alias("e"))
    r = rows.agg(F.sum(two(c("ra"))).alias("pr"), ent(c("ra")).alias("er"))
    k = cols.agg(F.sum(two(c("cb"))).alias("pc"), ent(c("cb")).alias("ec"))
    j = s.join(F.broadcast(r)).join(F.broadcast(k))
    expected = c("pr") * c("pc") / two(c("n"))
    half = (c("pr") + c("pc")) / 2
    ari = F.when(half == expected, 1.0).otherwise((c("pairs") - expected) / F.nullif(half - expected, lit(0.0)))
    hr, hc = F.ln("n") - c("er") / c("n"), F.ln("n") - c("ec") / c("n")
    mi = F.ln("n") + (c("e") - c("er") - c("ec")) / c("n")
    return j.select(ari.alias("ari"), F.when(hr + hc == 0, 1.0).otherwise(mi / F.nullif((hr + hc) / 2, lit(0.0))).alias("nmi"))


def representatives(points: DataFrame, k: int = 3) -> DataFrame:
    """(cluster, rank, entity_id, distance): the k points nearest to each centroid."""
    d = points.join(F.broadcast(centroids(points)), "cluster").select("cluster", "entity_id", F.sqrt(_sq("features", "center")).alias("distance"))
    # Row numbers are limits here: Spark keeps the first k of each task's rows before the shuffle.
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "entity_id")))
    return ranked.where(c("rank") <= k).select("cluster", "rank", "entity_id", "distance")
