"""Benchmark decontamination by greedy string tiling.

A document leaks an item if enough of the item's words stand in it, in whatever
order its passages come.  Documents and items are first joined on shared seeds: runs of
``SEED`` words, compared by hash; of a shorter item than three seeds, runs of a third of its words, but
of ``LEAST`` at least.  For each pair that meets, greedy string tiling
repeatedly takes the longest match of unmarked words, at least as long as a seed, in
both texts and marks its words, so that tiles never overlap; matches are found by
running Karp-Rabin hashes of the current length and compared word by word.  The item leaks if the marked
words make at least ``percent`` per cent of it.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``, one after another: each document
is read once per block, whole, and all its work stays in its task, so nothing is
shuffled and a passage in very many documents makes no large group.  A block is gone before the next one comes.

Defined results: null and blank texts and items meet nothing; items of less than ``LEAST`` words are too short to tell
anything and leak nowhere; very long texts are judged whole; of matches of equal length the first places count; repeated rows and
null ids are judged row by row; repeated items count once for each row; an
empty benchmark or table finds nothing; extra columns are kept by ``clean``, whatever their names, and
dropped by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm import textkit
from tidewheel.llm.scratch import numbered, save, small_batches

#: Words of a seed and least match; these of the shortest items; covered share of an item that makes a leak; the most of the benchmark's text in a task at once.
SEED, LEAST, PERCENT, BLOCK_BYTES = 8, 4, 50, 16 << 20
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _word_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per row the hashes of its bare words (A-Z lower-cased, without ASCII signs)."""
    with np.errstate(over="ignore"):
        for _, data, offsets in textkit.chunks(texts):
            hashes, _, _, bounds = textkit.words(data, offsets, textkit.SIGNS)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield hashes[a:b]


def running(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words, by doubling: a run is two shorter ones."""
    if len(words) < size or not size:
        return words[:0]
    with np.errstate(over="ignore"):
        out, width, power = None, 0, words
        length, base = 1, _ROLL
        left = size
        while left:
            if left & 1:
                part = power[width : width + len(words) - size + 1] if out is not None else power[: len(words) - size + 1]
                out = part.copy() if out is None else out * base + part
                width += length
            left >>= 1
            if left:
                power = power[: len(power) - length] * base + power[length:]
                length, base = length * 2, base * base
        return textkit.mix(out)


def seed_of(n: int) -> int:
    """Words of a seed of an item of n words; 0 if it is too short."""
    return min(SEED, max(LEAST, n // 3)) if n >= LEAST else 0


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first, ties by place.

    Lengths fall from the longest possible; a pass takes every match of the
    current length whose words are unmarked in both.
    """
    least = max(1, min(least, len(item)))
    free_i, free_t, found = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool), []

    def matches(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of free words of this length that both have: places in the item, and the hashes' places in the text."""
        hi, ht = running(item, size), running(text, size)
        oi, ot = (np.flatnonzero(np.convolve(~f, np.ones(size, dtype=np.int64))[size - 1 : len(f)] == 0) if len(f) >= size else np.zeros(0, dtype=np.int64) for f in (free_i, free_t))
        common = np.intersect1d(hi[oi], ht[ot])
        keep = lambda h, o: o[np.isin(h[o], common)]
        return keep(hi, oi), keep(ht, ot)

    while True:
        low, high = least - 1, min(int(free_i.sum()), int(free_t.sum()))
        while low < high:  # the longest length that still has a match
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(matches(mid)[0]) else (low, mid - 1)
        if low < least:
            return found
        hi, ht = running(item, low), running(text, low)
        at_i, at_t = matches(low)
        order = np.argsort(ht[at_t], kind="stable")  # places of one hash stay in order
        at_t, sorted_t = at_t[order], ht[at_t][order]
        next_at = {h: int(a) for h, a in zip(*np.unique(sorted_t, return_index=True), strict=True)}
        for i in at_i.tolist():
            if not free_i[i : i + low].all():
                continue
            # A place that is not free, or whose words differ in spite of the hash, stays so: it is passed for good.
            a = next_at[hi[i]]
            while a < len(at_t) and sorted_t[a] == hi[i]:
                t = int(at_t[a])
                a += 1
                if free_t[t : t + low].all() and np.array_equal(item[i : i + low], text[t : t + low]):
                    free_i[i : i + low] = free_t[t : t + low] = False
                    found.append((i, t, low))
                    break
            next_at[hi[i]] = a
        if not found or found[-1][2] != low:  # all that was left were collisions
            return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    held, size = [], 0
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if held and size + len(r[1]) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def _find(block, item_kind: pa.DataType, percent: int, narrow: int) -> Callable:
    def prepared() -> tuple:
        ids, texts = zip(*block.value, strict=True)
        items = list(_word_rows(pa.array(texts, pa.large_string())))
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, words in enumerate(items):
            if size := seed_of(len(words)):
                h = running(words, size)
                by_size.setdefault(size, []).append((h, np.full(len(h), i)))
        seeds = {}
        for size, parts in by_size.items():
            h, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            seeds[size] = (h[order], owner[order])
        return ids, items, seeds

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, seeds = prepared()
        for batch in batches:
            row, item, covered, whole, spans = [], [], [], [], []
            for r, words in enumerate(_word_rows(batch.column(narrow))):
                met: set[int] = set()
                for size, (h, owner) in seeds.items():
                    own = running(words, size)
                    hit = own[h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own] if len(own) else own
                    for x in np.unique(hit):
                        met.update(owner[np.searchsorted(h, x) : np.searchsorted(h, x, side="right")].tolist())
                for i in sorted(met):
                    found = tiles(items[i], words, seed_of(len(items[i])))
                    marked = sum(n for _, _, n in found)
                    if 100 * marked >= percent * len(items[i]) > 0:
                        row.append(r)
                        item.append(ids[i])
                        covered.append(marked)
                        whole.append(len(items[i]))
                        spans.append([{"item_at": i_, "text_at": t_, "words": n_} for i_, t_, n_ in found])
            span = pa.list_(pa.struct([("item_at", pa.int64()), ("text_at", pa.int64()), ("words", pa.int64())]))
            kept = batch.select(list(range(narrow))).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(item, item_kind), pa.array(covered, pa.int64()), pa.array(whole, pa.int64()), pa.array(spans, span)], [*kept.schema.names, "item_id", "covered_words", "item_words", "tiles"]
            )

    return find


def _leaks(docs: DataFrame, benchmark: DataFrame, percent: int, keep: list[str], text: str, item_col: str, item_text: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what leaks, for every block of the benchmark."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    kind = benchmark.schema[item_col].dataType
    schema = docs.select(*keep).schema.add("item_id", kind).add("covered_words", "long").add("item_words", "long").add("tiles", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("item_at", "text_at", "words")])))
    narrow, out = docs.select(*keep, text), []
    blocks = _blocks(benchmark, item_col, item_text)
    block = next(blocks, None)
    while block is not None:
        held, block = spark.sparkContext.broadcast(block), next(blocks, None)
        part = narrow.mapInArrow(_find(held, to_arrow_type(kind), percent, len(keep)), schema)
        if block is not None or out:  # of several blocks each one's rows are written before the next is read
            part = save(part, "leaks")
            held.destroy()
        out.append(part)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that leaks: doc_id, item_id, covered_words, item_words, tiles."""
    found = _leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, percent, ["doc_id"], "text", item_col, item_text)
    return found.select("doc_id", "item_id", "covered_words", "item_words", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns unchanged.

    A row goes if its id and the hash of its text are those of a leaking row.
    """
    rows, (own_id, text) = numbered(docs, id_col, text_col)
    mark = F.xxhash64(F.col(own_id), F.coalesce(F.col(text), F.lit("")))
    found = _leaks(rows.select(mark.alias("mark"), F.col(text).alias("text")), benchmark, percent, ["mark"], "text", item_col, item_text)
    gone = save(found.select(F.col("mark").alias("gone")).distinct(), "leaking")
    return rows.join(gone, mark == F.col("gone"), "left_anti").toDF(*docs.columns)
