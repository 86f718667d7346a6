"""Merkle manifest of a table: a tree of digests for each group, and a tree over the groups.

A leaf is the digest of a row.  Leaves of a group ascend by a key; every eight
consecutive nodes become the digest of their concatenation until one is left,
the group's subroot, and the subroots, in the order of their groups, make the
root in the same way.  A row's path holds, level by level, what stands left and
right of its node; it proves that the row belongs to the root.

Every level is a window with fixed offsets.  A node stands in the row of its
first leaf, so its siblings are lags and leads by multiples of 8 ** level rows,
masked by its slot and the length of its run, and the row of a run's first
child hashes the parent.  Rows are dealt by group and run of 8 ** TIER leaves,
never by group alone: all levels of such a chunk are windows over one exchange
and one sort, and the chunks' roots are the leaves of the next tier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.scratch import LOWER, UPPER, doc_hash, save

#: Children of a node, and levels that are windows over one exchange: 32,768 rows at most.
FAN, TIER = 8, 5
NO_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"


def field(value: Column) -> Column:
    """How a value enters a leaf: ``-`` if null, else its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``i``, the place in ``g`` from 0, and ``n``, the nodes of ``g``.

    Rows are sorted through range partitions, so that a large group is many tasks; the runs of
    groups in partitions, few rows, are summed up by a window.
    """
    dealt = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("m", F.monotonically_increasing_id())
    kept = save(dealt, "merkle-order").withColumn("p", F.shiftright("m", 33))
    runs = kept.groupBy("g", "p").agg(F.count("*").alias("k"), F.min("m").alias("first"))
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("k").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("g", "p", (before - F.col("first")).alias("shift"), F.sum("k").over(own).alias("n"))
    return kept.join(starts, ["g", "p"]).withColumn("i", F.col("m") + F.col("shift")).drop("m", "p", "shift")


def _climbed(nodes: DataFrame) -> DataFrame:
    """Add ``chunk``, ``h{TIER}`` in the first row of each chunk, and ``levels``, the siblings up to the chunk's root."""
    at = lambda level: f"b{level}" if level else "i"
    rows = nodes.withColumns({at(k): F.floor(F.col("i") / FAN**k) for k in range(1, TIER + 1)}).withColumnRenamed("h", "h0")
    rows = rows.repartition("g", at(TIER))
    within = lambda level: Window.partitionBy("g", *[at(k) for k in range(TIER, level - 1, -1)]).orderBy(*[at(k) for k in range(level - 1, -1, -1)])
    steps = []
    for k in range(TIER):
        run, step, node = within(k + 1), FAN**k, F.col(f"h{k}")
        count = F.ceil(F.col("n") / step)
        slot = F.col(at(k)) - FAN * F.col(at(k + 1))
        length = F.least(F.lit(FAN), count - FAN * F.col(at(k + 1)))
        left = F.concat(*[F.when(slot >= j, F.lag(node, j * step).over(run)).otherwise("") for j in range(FAN - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < length, F.lead(node, j * step).over(run)).otherwise("") for j in range(1, FAN)])
        first = F.col("i") % step == 0
        rows = rows.withColumn(f"s{k}", F.when(first & (count > 1), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(count > 1, digest(node, F.col(f"s{k}.right"))).otherwise(node)
        rows = rows.withColumn(f"h{k + 1}", F.when(F.col("i") % (FAN * step) == 0, parent))
        # All leaves of the node take its siblings from the node's first row.
        steps.append(F.first(f"s{k}").over(within(k).rowsBetween(Window.unboundedPreceding, 0)) if k else F.col("s0"))
    rows = rows.withColumn("levels", F.array_compact(F.array(*steps)))
    return rows.withColumnRenamed(at(TIER), "chunk").withColumnRenamed("h0", "h").drop(*[at(k) for k in range(1, TIER)], *[f"s{k}" for k in range(TIER)], *[f"h{k}" for k in range(1, TIER)])


def _tree(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``path`` and what ``finish`` adds to the subroots: it gets (g, i, h), a row for each group, and returns (g, i, path, ...)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.join(finish(nodes.select("g", "i", "h")), ["g", "i"])
    climbed = _climbed(nodes)
    tops = climbed.where(F.col("i") % FAN**TIER == 0).select("g", F.col("chunk").alias("i"), F.ceil(F.col("n") / FAN**TIER).alias("n"), F.col(f"h{TIER}").alias("h"))
    above = _tree(save(tops, "merkle-tier"), finish).drop("h", "n").withColumnsRenamed({"i": "chunk", "path": "up"})
    return climbed.join(above, ["g", "chunk"]).withColumn("path", F.concat("levels", "up")).drop("levels", "up", "chunk", f"h{TIER}")


def manifest(rows: DataFrame, group: str, key: str, fields: list[str], altered: dict[str, Column] | None = None, alters: Column | None = None) -> DataFrame:
    """(key, group, leaf, altered_leaf, path, subroot, root), a row for each row.

    ``fields`` enter a leaf in their order.  ``altered_leaf`` is the leaf with the columns of ``altered``
    in the rows where ``alters`` holds, else null.  Leaves of a group ascend by key, nulls first, equal keys by
    their leaves, so that repeated rows have leaves of their own; the null group comes first, the others by their UTF-8 bytes.
    Null values have their own mark, so a null isn't an empty text; texts of any length are hashed whole.  An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    altered = altered or {}
    leaf = lambda own: digest(*[field(own.get(x, F.col(x))) for x in fields])
    # '' sorts before any '=...': the null group is first.
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(F.col(key).alias("key"), g.alias("g"), leaf({}).alias("h"), F.when(alters if alters is not None else F.lit(False), leaf(altered)).alias("other"))
    nodes = save(_numbered(save(leaves, "merkle-leaves"), ["key", "h"]), "merkle-leaves")

    def over_groups(subroots: DataFrame) -> DataFrame:
        tops = save(_numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("i").alias("at"), "h"), ["of"]), "merkle-groups")
        whole = _tree(tops, lambda one: one.select("g", "i", F.expr(NO_PATH).alias("path"), F.col("h").alias("root")))
        return whole.select(F.col("of").alias("g"), F.col("at").alias("i"), "path", F.col("h").alias("subroot"), "root")

    found = _tree(nodes, over_groups)
    return found.select(F.col("key").alias(key), F.nullif(F.substring("g", 2, 1 << 30), F.when(F.col("g") == "", F.lit(""))).alias(group), F.col("h").alias("leaf"), F.col("other").alias("altered_leaf"), "path", "subroot", "root")


def tampered_check(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, and the roots that its paths lead to when a third of the texts are tampered with.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).  Tampering lower-cases A-Z of the texts whose
    id's crc32 3 divides (a null id counts as the empty text); a text without such letters, or a null one, is unchanged and stays verified.
    """
    made = manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.translate("text", UPPER, LOWER)}, doc_hash() % 3 == 0)
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("altered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
