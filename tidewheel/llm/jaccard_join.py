"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when their sets of k-word shingles have a Jaccard similarity of
at least ``percent`` / 100.  Linked texts of sizes x and y share at least
``o = ceil(percent * (x + y) / (100 + percent))`` shingles.  So if all sets are sorted by one
global order, the first ``x - o + l`` shingles of one and the first ``y - o + l`` of the
other have at least l in common.  A text keeps a prefix that is long enough for its
smallest possible partner and for an l of its own: it picks the l that costs it
least, as a longer prefix makes more postings but needs more matches, so
fewer candidates are verified.  A pair is judged by the smaller l of the two.

A shingle at place i of a set of size x can only serve pairs whose o is at most
``x + l - 1 - i``, which bounds the size of the partner: its ``reach``.  Two postings
of one list meet only if each one's size is within the other's reach.  Most
of a prefix reaches smaller partners only, so large groups of texts that share
a passage without being alike hardly meet.

The order is by document frequency, as a fixed-size table of counters
over hashed shingles estimates it from all documents: any order gives the same
links, a good one puts shared passages last.  The table is merged from one
per task and its size is a parameter, so it is safe to hand to all tasks.

Texts with equal sets form one class and are compared once.  Large groups of near
copies would still make all pairs within a posting list, so links are found in
steps.  Every list names as its hub the class that is on most lists; each text is
verified against the hub with which it shares most lists and against the most
central one, and components are built.  Then only pairs from
different components are listed.  For that a list is first summed up by
component and size, and these sums meet; only those that can hold a pair are
opened.  Pairs inside a component can't change it any more.  Every pair of linked texts
is thus in one component, and the work follows the number of possible pairs
between components, not the square of a group.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows with equal texts are in one class, whatever their ids; rows of
one id with different texts are judged as different texts; a null id is in a
component but never names one unless all its ids are null; an empty table
gives an empty result; extra input columns are dropped by ``jaccard_classes`` and
kept, whatever their names, by ``keep_one``.

Words, shingles and sets are compared by 64-bit hashes, not letter by letter: two of
10 ** 9 different sets have the same one with a chance of 3 %.  A word's hash is a
polynomial in an odd base modulo 2 ** 64, so words made for the purpose, of
thousands of letters, can collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm import textkit
from tidewheel.llm.components import components
from tidewheel.llm.scratch import free, numbered, save, small_batches

#: log2 of the number of frequency counters; most matches asked for; cost of a verified pair per shingle, of a posting.
SKETCH_BITS, MOST_MATCHES, VERIFY_COST, POSTING_COST = 22, 8, 0.02, 0.5
_PARTS = 64
#: Pairs of one class that are verified in the round before the last.
FIRST_PAIRS = 3
#: The most that is broadcast, and what a wanted class takes there.
BROADCAST_BYTES, WANTED_ROW = 64 << 20, 48


def _count_cells(k: int, bits: int) -> Callable:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = np.zeros(1 << bits, dtype=np.int64), [], 0
        for batch in batches:
            for s in textkit.shingle_sets(batch.column(0), k):
                held.append(s >> np.uint64(64 - bits))
                size += len(s)
                if size > 1 << 20:
                    table += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
                    held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
        if table.any():
            # A task's own counts are small; a counter that is full stays at its end of the order.
            counts = np.minimum(table, 2**16 - 1).astype("<u2").reshape(_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["part", "cells"])

    return cells


def _add_cells(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in rows:
        for x in batch.column("cells"):
            c = np.frombuffer(x.as_py(), dtype="<u2").astype(np.int64)
            total = c if total is None else total + c
    cells = np.minimum(total, 2**31 - 1).astype("<i4").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([cells], pa.binary())], ["part", "cells"])


def frequency_sketch(texts: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Document frequencies of hashed shingles over all documents, 4 * 2 ** bits bytes."""
    local = texts.mapInArrow(_count_cells(k, bits), "part int, cells binary")
    merged = local.groupBy("part").applyInArrow(_add_cells, "part int, cells binary").collect()
    table = np.zeros((_PARTS, (1 << bits) // _PARTS), dtype=np.int32)
    for r in merged:
        table[r["part"]] = np.frombuffer(r["cells"], dtype="<i4")
    return table.reshape(-1)


def required(n: int, percent: int) -> int:
    """The shingles that a set of n shares with any set it links with, at least."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[int, np.ndarray]:
    """The number of matches asked for, and the prefix of that length.

    counts: estimated document frequencies; noise: what a counter holds by chance.
    """
    n = len(tokens)
    shortest = n - required(n, percent) + 1
    most = min(MOST_MATCHES, n - shortest + 1)
    order = np.argsort(counts, kind="stable")[: shortest + most - 1]
    others = np.cumsum(np.maximum(counts[order] - 1 - noise, 0))
    lengths = np.arange(shortest, shortest + most)
    cost = POSTING_COST * lengths + others[lengths - 1] * (1 + VERIFY_COST * n / np.arange(1, most + 1))
    best = int(np.argmin(cost)) + 1
    return best, tokens[order[: shortest + best - 1]]


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(np.sum(textkit.mix(tokens + np.uint64(len(tokens)))).view(np.int64))


def _sign(k: int, percent: int, cells) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cells.value
        shift = np.uint64(64 - (len(table).bit_length() - 1))
        noise = float(table.sum(dtype=np.int64)) / len(table)
        for batch in batches:
            n, keys, asked, kept = [], [], [], []
            with np.errstate(over="ignore"):
                for s in textkit.shingle_sets(batch.column(1), k):
                    n.append(len(s))
                    keys.append(set_key(s))
                    m, p = prefix(s, table[s >> shift], noise, percent) if len(s) else (0, s)
                    asked.append(m)
                    kept.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(asked, pa.int32()), textkit.ragged(kept, pa.int64())], ["doc_id", "n", "key", "matches", "tokens"]
            )

    return sign


def _judge(k: int, percent: int) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, kept = [], None, None
            sides = zip(batch.column("a").to_pylist(), batch.column("text_a"), textkit.shingle_sets(batch.column("text_b"), k), strict=True)
            for key, text, y in sides:
                if key != last:
                    last, kept = key, next(textkit.shingle_sets(pa.array([text.as_py()], pa.large_string()), k))
                shared = len(kept) + len(y) - len(np.union1d(kept, y))
                linked.append(100 * shared >= percent * (len(kept) + len(y) - shared) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return judge


def _keyed(k: int) -> Callable:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat an id and a text need not travel again
        for batch in batches:
            with np.errstate(over="ignore"):
                own = [set_key(s) for s in textkit.shingle_sets(batch.column("text"), k)]
            same = []
            for mine, key in zip(own, batch.column("key").to_pylist(), strict=True):
                same.append(mine == key and key not in seen)
                seen.add(key)
            yield batch.select(["key", "text"]).filter(pa.array(same, pa.bool_()))

    return keyed


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) of the saved ``pairs`` whose texts link; texts travel, as they are smaller than their sets."""
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "rep"), "key"), "wanted")
    # With few wanted classes their ids go to the texts; with many, texts are dealt out by id.
    hint = F.broadcast(wanted) if wanted.count() * WANTED_ROW <= BROADCAST_BYTES else wanted
    # An id may stand for several texts: only those with the wanted set count.
    found = texts.join(hint, F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "text").mapInArrow(_keyed(k), "key long, text string")
    a, b = (found.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    links = save(both.mapInArrow(_judge(k, percent), "a long, b long"), "links")
    free(wanted)
    return links


def overlap(x: Column, y: Column, percent: int) -> Column:
    """The least number of shingles that linked sets of these sizes share."""
    return F.ceil(percent * (x + y) / (100 + percent))


def reach(place: Column, n: Column, matches: Column, percent: int) -> Column:
    """The size of the largest partner whose pair a shingle at this place can serve."""
    return F.floor((100 + percent) * (n + matches - 1 - place) / percent) - n


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _candidates(shared: DataFrame, comps: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b, hits), saved, of the pairs not yet ``known`` of classes from different components that share as many prefix shingles as they must."""
    far = reach(F.col("place"), F.col("n"), F.col("matches"), percent)
    at = shared.join(comps, F.col("key") == F.col("node"), "left").select("token", "key", "n", "matches", "place", far.alias("reach"), F.coalesce("comp", "key").alias("comp"))
    at = save(at, "placed")
    # A list by component and size: what can't hold a pair here is not opened.
    sums = at.groupBy("token", "comp", "n").agg(F.max("reach").alias("reach"), F.min("matches").alias("matches"))
    a, b = (sums.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", "reach", "matches")]) for x in "ab")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("comp_a") < F.col("comp_b")))
    near = (F.col("reach_a") >= F.col("n_b")) & (F.col("reach_b") >= F.col("n_a")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    # The smaller one has to reach a larger one: most lists have few such sums.
    met = save(a.where("reach_a >= n_a").join(b, "token").where((F.col("comp_a") != F.col("comp_b")) & smaller & near).drop("reach_a", "reach_b"), "meet")
    # Two sums must meet on as many lists as a pair of theirs must share.
    sizes = ["comp_a", "n_a", "comp_b", "n_b"]
    often = met.groupBy(*sizes).agg(F.count("*").alias("lists"), F.min(F.least("matches_a", "matches_b")).alias("least")).where("lists >= least")
    meet = met.join(often.select(*sizes), sizes).select("token", *sizes)
    side = lambda x: at.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", "key", "matches", "place", "reach")])
    one = meet.join(side("a"), ["token", "comp_a", "n_a"]).where(F.col("reach_a") >= F.col("n_b"))
    two = one.join(side("b"), ["token", "comp_b", "n_b"]).where(F.col("reach_b") >= F.col("n_a"))
    least, o = F.least("matches_a", "matches_b"), overlap(F.col("n_a"), F.col("n_b"), percent)
    inside = (F.col("place_a") < F.col("n_a") - o + least) & (F.col("place_b") < F.col("n_b") - o + least)
    found = two.where(inside).groupBy(*_ordered(F.col("key_a"), F.col("key_b")), least.alias("least")).agg(F.count("*").alias("hits"))
    out = save(found.where("hits >= least").select("a", "b", "hits").join(known, ["a", "b"], "left_anti"), "crossed")
    free(at, met)
    return out


def jaccard_classes(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Per row: doc_id, n (set size), key (its class), comp (its component's class), component_id (least id in it)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cells = spark.sparkContext.broadcast(frequency_sketch(texts.select("text"), k, sketch_bits))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    signed = save(texts.mapInArrow(_sign(k, percent, cells), f"doc_id {id_type}, n long, key long, matches int, tokens array<long>"), "signed")
    cells.destroy()
    classes = save(
        signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("tokens").alias("tokens")), "classes"
    )
    postings = classes.select("key", "n", "matches", F.posexplode("tokens").alias("place", "token"))
    lists = postings.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token")
    shared = save(postings.join(lists, "token"), "shared")

    # Round one: every class against two hubs of its lists: those on most lists are the most central.
    weight = save(shared.groupBy("key").agg(F.count("*").alias("lists")), "weights")
    entry = F.struct("lists", "key", "n", "matches")
    weighed = shared.join(weight, "key")
    best = weighed.groupBy("token").agg(F.max(entry).alias("hub"))
    alike = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    hubs = shared.join(best, "token").where((F.col("key") != F.col("hub.key")) & alike)
    met_hubs = hubs.groupBy("key", F.col("hub.key").alias("hub"), F.least("matches", "hub.matches").alias("least"), F.col("hub.lists").alias("lists")).agg(F.count("*").alias("hits"))
    likely = met_hubs.where("hits >= least").groupBy("key").agg(F.max_by("hub", F.struct("hits", "hub")).alias("most"), F.max_by("hub", F.struct("lists", "hub")).alias("central"))
    first = save(likely.select("key", F.explode(F.array("most", "central")).alias("hub")).select(*_ordered(F.col("key"), F.col("hub"))).distinct(), "pairs")
    links = _verified(first, classes, texts, k, percent)
    comps = components(links)

    # Round two: what may link components.  Likeliest pairs come first, as they join components, inside which no pair needs a look any more.
    todo = _candidates(shared, comps, first, percent)
    free(weight, shared, first)
    if not todo.isEmpty():
        ends = todo.select("a", "b", "hits", F.explode(F.array("a", "b")).alias("end"))
        rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("hits"), "a", "b"))
        now = save(ends.withColumn("rank", rank).where(F.col("rank") <= FIRST_PAIRS).select("a", "b").distinct(), "pairs")
        links = links.union(_verified(now, classes, texts, k, percent))
        comps = components(links)
        of = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
        left = todo.join(now, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = save(left.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "pairs")
        if not rest.isEmpty():
            comps = components(links.union(_verified(rest, classes, texts, k, percent)))

    named = classes.select("key", "rep").join(comps, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "key").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = save(named.join(least, "comp").select("key", "comp", "component_id"), "by-class")
    free(classes)
    out = signed.select("doc_id", "n", "key").join(by_class, "key", "left")
    linked = F.col("n") > 0
    return out.select("doc_id", "n", F.when(linked, F.col("key")).alias("key"), F.when(linked, F.col("comp")).alias("comp"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _add_key(k: int, at: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                keys = [set_key(s) if len(s) else None for s in textkit.shingle_sets(batch.column(at), k)]
            yield batch.append_column("key", pa.array(keys, pa.int64()))

    return add


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each component the row with the least id stays.

    Texts without words have no near copies, so all their rows stay.  Of rows
    that repeat the least id, one with the least set stays, and of these the one with the least text; a null id counts as greatest.
    """
    found = jaccard_classes(docs, k, percent, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stays = save(found.where("key is not null").groupBy("comp").agg(F.min(rank).alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.key").alias("stay")), "stay")
    rows, (own_id, text) = numbered(docs, id_col, text_col)
    keyed = rows.mapInArrow(_add_key(k, docs.columns.index(text_col)), T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))
    met = keyed.join(stays, F.col(own_id).eqNullSafe(F.col("id")) & (F.col("key") == F.col("stay")), "left").where("key is null or stay is not null")
    # Rows without words are told apart by their place; of others few repeat an id and a set.
    alone = met.withColumn("alone", F.when(F.col("key").isNull(), F.monotonically_increasing_id()))
    nth = F.row_number().over(Window.partitionBy(own_id, "key", "alone").orderBy(text))
    return alone.withColumn("nth", nth).where("nth = 1").select(*rows.columns).toDF(*docs.columns)
