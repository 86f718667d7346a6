"""Best-fit packing of token sequences by minimum bin slack.

Documents become subword ids plus an end id; only those above the capacity are
cut.  Bins are filled one after another: the longest piece left opens a bin, and
a subset-sum dynamic programme over the lengths left, kept as a bitset of
reachable fills, finds the fullest feasible combination for the rest, which
is then removed.  Pieces of one length are alike, so the programme runs on the
histogram of lengths (as many numbers as the capacity, however large the corpus)
and each combination is used as often as the counts allow.  Pieces then find
their places by their rank among the pieces of their length: ranks are counted
inside each task when pieces are written, and offsets of (task, length) pairs
make them global.  No text and no piece passes through the driver.

Defined results: null and empty texts have the end id alone; very long texts are cut, but lose nothing; rows with equal
or null ids are packed row by row; which of the pieces of one length comes first is left open; an empty table gives an empty result; extra
input columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import subwords
from tidewheel.llm.scratch import save, small_batches

CAPACITY, END_ID = 4096, 1
ROWS = 2000


def _cut(path: str, capacity: int, end_id: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, rank = subwords.coder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, bounds = coder.encode(batch.column(1))
                row, piece, start, size, crc, local = [], [], [], [], [], []
                for i in range(batch.num_rows):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, a in enumerate(range(0, len(own), capacity)):
                        cut_off = own[a : a + capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(a)
                        size.append(len(cut_off))
                        crc.append(zlib.crc32(cut_off.tobytes()))
                        local.append(rank[len(cut_off)])
                        rank[len(cut_off)] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc)), pa.array([part] * len(row), pa.int32()), pa.array(local, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
                )

    return cut


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The (length, times) of a fullest combination of at most ``room``, long pieces first."""
    reach, steps, want = 1, [], 1 << room
    keep = (want << 1) - 1
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, copies = min(int(counts[size]), room // size), 1
        while left:
            take = min(copies, left)
            steps.append((size, take, reach))
            reach |= reach << size * take & keep
            left, copies = left - take, copies * 2
        if reach & want:
            break
    fill, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> fill & 1:
            fill -= size * take
            used[size] = used.get(size, 0) + take
    return sorted(used.items(), reverse=True)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset) that place every piece.

    counts[s] is the number of pieces of length s, 1 .. capacity.
    """
    left, given, rows, bins = counts.astype(np.int64).copy(), np.zeros(capacity + 1, dtype=np.int64), [], 0
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            break
        longest = int(there[-1])
        left[longest] -= 1
        used = dict(fullest(left, capacity - longest)) if longest < capacity else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(left[s]) // m for s, m in used.items())
        offset = 0
        for s, m in sorted(used.items(), reverse=True):
            rows.append((s, given[s], bins, m, offset))
            given[s] += times * m
            left[s] -= times * m
            offset += s * m
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(table) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        size, first, bins, each, offset = rows.T
        begin = np.searchsorted(size, np.arange(size.max() + 2)) if len(rows) else np.zeros(2, dtype=np.int64)
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.zeros(len(length), dtype=np.int64)
            for s in np.unique(length):
                own = length == s
                a, b = begin[s], begin[s + 1]
                at[own] = a + np.searchsorted(first[a:b], rank[own], side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = save(texts.mapInArrow(_cut(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, local long"), "pieces")
    counts = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most as many rows as the capacity
        histogram[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # There are as many offsets as tasks times lengths, so they are never broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_place(places), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
