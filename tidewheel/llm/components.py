"""Connected components by alternating stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewheel.llm.scratch import free, save


def _saved(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and their count and sum, which are observed while they are written."""
    seen = Observation()
    out = save(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")), name)
    return out, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge list; comp is the least node of its component.

    Large-star and small-star steps alternate until the edges are stars around
    the least nodes; O(log^2) rounds.  A step is a minimum per node, combined
    before the shuffle, and a join back to the edges whose large nodes adaptive
    execution can split, so no neighbourhood is ever gathered in one place.
    Each step is one written table, and the one before it is deleted.
    """
    e, seen = _saved(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct(), "edges")
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, old = seen, e
        e, seen = _saved(small, "stars")
        free(old)
        if seen == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
