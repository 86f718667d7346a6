"""Reproducible shuffle into shards by a Feistel permutation, in DataFrame functions only.

Rows get global numbers 0 .. n-1 in a total order of their content.  A keyed
Feistel network over a rectangle a x b just above n, walked until it lands
below n (cycle walking), permutes the numbers.  Position p goes to shard
``p mod k`` and slot ``p div k``: shard sizes differ by one row at most, slots
have no gaps, and anyone who knows (n, key) can compute where row i went, or
by running the rounds backwards which row is at a place, without any table.

Numbers are given out in two steps, as no task may see all rows: the narrow
(id, size, crc32) rows are range-sorted and written, each with its partition
and its place in it; partition counts, one row per partition, give the
offsets.

Defined results: a null text has no bytes (size 16, crc32 of no bytes 0);
null ids sort first; repeated rows are equal in all that the order compares,
so which of them gets which number does not change the result; an empty table
gives an empty result; extra input columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.scratch import let, save

ROUNDS = 6


def rectangle(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square rectangle with at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, key: int) -> Column:
    """One pass of the keyed permutation of 0 .. a*b-1 (not yet walked)."""
    a, b = rectangle(n)

    def step(s: Column, j: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], j, F.lit(key)), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], j, F.lit(key)), F.lit(b)), F.lit(b))
        return F.struct(F.when(j % 2 == 0, left).otherwise(s["l"]).cast("long").alias("l"), F.when(j % 2 == 1, right).otherwise(s["r"]).cast("long").alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(j) for j in range(ROUNDS)]), start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(x: Column, n: int, key: int) -> Column:
    """The walked permutation of 0 .. n-1.

    Fewer than a of the a*b cells lie outside, so a walk leaves after one more
    step than there are such cells at the latest, and 64 steps fail with a
    chance below n ** -32; if that ever happens the query stops with an error
    rather than misplace a row.
    """
    a, b = rectangle(n)
    walks = min(a * b - n + 1, 64)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), feistel(x, n, key), lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, key)))
    return let(walked, lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk did not end"))))


def shard_rows(docs: DataFrame, shards: int = 40, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ordered = save(save(narrow, "shard-rows").orderBy("doc_id", "text_crc32", "size").withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition of the sort, so this window's single task stays small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "shard-offsets")
    n = offsets.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn("row_number", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = numbered.withColumn("_p", permute(F.col("row_number"), max(n, 1), key))
    return placed.select("doc_id", "size", "text_crc32", "row_number", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))
