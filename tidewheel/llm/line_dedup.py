"""Line dedup over the whole corpus: a sharded minimal perfect hash over line hashes that documents probe.

One scan reduces lines to 64-bit hashes; what repeats in several documents is
dealt to shards by its top bits.  A shard numbers its hashes without gaps by a
minimal perfect hash (bit arrays by level: a hash that is alone in its place of a
level takes it, the others go on to the next) and keeps compact arrays in that order: a
48-bit fingerprint, the number of documents, the least document.  A second scan
of the texts probes those arrays; lines are never joined.

Shards are sent out in groups of bounded size.  With more than one group a
task goes through them one after another for each stretch of text and holds one at a
time, so the texts are read once, however many lines repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import free, numbered, save, small_batches
from tidewheel.llm.textkit import byte_sums, mix, parts, plain

#: Parameters: the most hashes of a shard on average, bytes of arrays sent out at once, bytes of text probed at once, and distinct lines of a task held at once.
SHARD, GROUP, STRETCH, HELD = 1 << 15, 64 << 20, 4 << 20, 1 << 18
#: The least code points of a line that counts, its least number of documents; what stands for a null id: it is the greatest.
LEAST, COPIES = 10, 2
NO_ID = (1 << 63) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
INDEX = "shard long, sizes array<int>, bits binary, low binary, high binary, documents binary, least binary"


@dataclass(frozen=True)
class Lines:
    """The lines of a run of texts: byte starts and ends, first line of each text, key hashes, and whether the key is long enough."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The text of every line."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_lines(texts: pa.Array, least: int = LEAST) -> Lines:
    """Split at line feeds; a key is the line without white space at its ends, A-Z lower-cased.  Null texts are empty; an empty one has one empty line."""
    texts = plain(texts)
    offsets, data = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    feeds = np.flatnonzero(data == 10)
    before = np.searchsorted(feeds, offsets)  # line feeds before each text
    bounds = before + np.arange(len(offsets))
    starts, ends = np.empty(bounds[-1], dtype=np.int64), np.empty(bounds[-1], dtype=np.int64)
    inner = np.arange(len(feeds)) + np.repeat(np.arange(len(texts)), np.diff(before))  # the line that each line feed ends
    ends[inner], starts[inner + 1] = feeds, feeds + 1
    starts[bounds[:-1]], ends[bounds[1:] - 1] = offsets[:-1], offsets[1:]
    solid = np.flatnonzero(~_SPACE[data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    full = last >= first
    a, b = (np.where(full, solid[np.minimum(x, len(solid) - 1)], 0) if len(solid) else np.zeros(len(starts), dtype=np.int64) for x in (first, np.maximum(last, 0)))
    b = np.where(full, b + 1, a)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # bytes that begin a code point
    with np.errstate(over="ignore"):
        keys = mix(parts(byte_sums(data), a, b) + (b - a).astype(np.uint64)) if len(data) else np.zeros(len(starts), dtype=np.uint64)
    return Lines(data, starts, ends, bounds, keys, full & (points[b] - points[a] >= least))


def _stretches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Tables of whole rows of some STRETCH bytes of text, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            size += part.column(column).nbytes
            held.append(part)
            if size >= STRETCH:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _merged(k: np.ndarray, n: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return (k[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at)) if len(at) else (k, n, lo)


def _held_by(least: int) -> Callable:
    """(key, documents, least id) of the lines of a task, combined as long as they fit."""

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        out = lambda k, n, lo: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n), pa.array(lo)], ["k", "n", "lo"])
        held = (none.astype(np.uint64), none, none)
        for table in _stretches(batches, 1):
            own = split_lines(table.column(1), least)
            rows = own.rows[own.counts]
            # A line counts once a document.
            order = np.lexsort((rows, own.keys[own.counts]))
            k, r = own.keys[own.counts][order], rows[order]
            once = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, dtype=bool)
            ids = table.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()
            k, r = k[once], r[once]
            held = _merged(*(np.concatenate(x) for x in zip(held, (k, np.ones(len(k), dtype=np.int64), ids[r]), strict=True)))
            if len(held[0]) > HELD:
                yield out(*held)
                held = (none.astype(np.uint64), none, none)
        if len(held[0]):
            yield out(*held)

    return held_by


def _place(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(1)


def _prints(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint: 32 and 16 bits that the places and shards do not tell."""
    h = _place(keys, -1 << 20)
    return h.astype(np.uint32), (h >> np.uint64(40)).astype(np.uint16)


def perfect(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, all their bits, and the order of the distinct keys by number."""
    sizes, bits, order, left = [], [], [], np.arange(len(keys))
    while len(left):
        size = (len(left) * 3 // 2 + 63) // 64 * 64
        at = (_place(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        order.append(left[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(alone)
        left = left[~mine]
    return sizes, np.concatenate(bits), np.concatenate(order)


def _built(shift: int) -> Callable:
    """The index of every shard; rows come by shard, so one shard is held at a time."""

    def one(shard: int, k: np.ndarray, n: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
        sizes, bits, order = perfect(k)
        low, high = _prints(k[order])
        row = [shard, sizes, np.packbits(bits, bitorder="little").tobytes(), low.tobytes(), high.tobytes(), np.minimum(n[order], (1 << 32) - 1).astype(np.uint32).tobytes(), lo[order].tobytes()]
        kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds, strict=True)], ["shard", "sizes", "bits", "low", "high", "documents", "least"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            k, n, lo = (batch.column(i).to_numpy() for i in range(3))
            k = k.view(np.uint64)
            own = (k >> np.uint64(shift)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and own[a] != now:
                        yield one(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                        held = []
                    now = int(own[a])
                    held.append((k[a:b], n[a:b], lo[a:b]))
        if held:
            yield one(now, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return built


@dataclass(frozen=True)
class Index:
    """Shards first to last, as arrays one after another; slots are numbered through."""

    first: int
    shift: int
    starts: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    documents: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, rows: list, shift: int) -> Index:
        first, last = rows[0]["shard"], rows[-1]["shard"]
        depth = max(len(r["sizes"]) for r in rows)
        sizes = np.zeros((depth, last - first + 1), dtype=np.int64)
        for r in rows:
            sizes[: len(r["sizes"]), r["shard"] - first] = r["sizes"]
        flat = sizes.T.ravel()
        starts = (np.cumsum(flat) - flat).reshape(-1, depth).T
        join = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), dtype=kind)
        bits = join("bits", np.uint8)
        ones = np.cumsum(np.bitwise_count(bits.view(np.uint64)).astype(np.int64))
        ranks = np.concatenate([[0], ones[:-1]]).astype(np.int64) if len(ones) else ones
        return cls(first, shift, starts, sizes, bits, ranks, join("low", np.uint32), join("high", np.uint16), join("documents", np.uint32), join("least", np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 where it is not in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        shard = (keys >> np.uint64(self.shift)).astype(np.int64) - self.first
        open_ = np.flatnonzero((shard >= 0) & (shard < self.sizes.shape[1]))
        words = self.bits.view(np.uint64)
        for level in range(len(self.sizes)):
            size = self.sizes[level][shard[open_]]
            open_, size = open_[size > 0], size[size > 0]
            at = self.starts[level][shard[open_]] + (_place(keys[open_], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = (self.ranks[at >> 6] + below)[here]
            open_ = open_[~here]
        found = np.flatnonzero(out >= 0)
        low, high = _prints(keys[found])
        right = (self.low[out[found]] == low) & (self.high[out[found]] == high)
        out[found[~right]] = -1
        return out


def _dropped(keys: np.ndarray, ids: np.ndarray, groups: list[Broadcast], least: int) -> np.ndarray:
    """Whether a document of such an id loses a line of such a key."""
    out = np.zeros(len(keys), dtype=bool)
    for group in groups:
        index = group.value
        slot = index.slots(keys)
        hit = np.flatnonzero(slot >= 0)
        slot = slot[hit]
        out[hit] |= (index.documents[slot] >= least) & (index.least[slot] != ids[hit])
        if len(groups) > 1:  # one group at a time stays in memory; it lies on the executor's disk
            vars(group).pop("_value", None)
    return out


def _cleaned(groups: list[Broadcast], id_at: int, text_at: int, kind: pa.DataType, least: int, copies: int) -> Callable:
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stretches(batches, text_at):
            own = split_lines(table.column(text_at), least)
            ids = table.column(id_at).cast(pa.int64()).fill_null(NO_ID).to_numpy()
            rows = own.rows
            gone = np.zeros(len(rows), dtype=bool)
            gone[own.counts] = _dropped(own.keys[own.counts], ids[rows[own.counts]], groups, copies)
            lines = np.diff(own.bounds)
            lost = np.add.reduceat(gone, own.bounds[:-1], dtype=np.int64) if len(lines) else lines
            texts = [None] * len(lines)
            for r in np.flatnonzero(lost):
                kept = [own.data[own.starts[i] : own.ends[i]].tobytes() for i in range(own.bounds[r], own.bounds[r + 1]) if not gone[i]]
                texts[r] = b"\n".join(kept)
            left = pa.array(texts, type=pa.binary()).cast(pa.string()) if any(t is not None for t in texts) else pa.nulls(len(texts), pa.string())
            old = table.column(text_at).cast(kind)
            new = pa.compute.if_else(pa.array(lost > 0), left.cast(kind), old)
            full = table.set_column(text_at, table.schema.names[text_at], new).append_column("_lines", pa.array(lines)).append_column("_gone", pa.array(lost))
            yield from full.combine_chunks().to_batches()

    return cleaned


def line_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, copies: int = COPIES) -> tuple[DataFrame, int]:
    """The saved index of lines that at least ``copies`` rows hold, a row for each shard, and the bits by which a hash is shifted to its shard."""
    small_batches(docs.sparkSession)
    seen = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(_held_by(least), "k long, n long, lo long")
    shared = save(seen.groupBy("k").agg(F.sum("n").alias("n"), F.min("lo").alias("lo")).where(F.col("n") >= copies), "lines")
    bits = max(1, math.ceil(math.log2(max(1, shared.count() / SHARD))))
    shift = 64 - bits
    # Dealt by shard and read shard after shard; a shard has some SHARD rows, as hashes are even.
    shard = F.shiftrightunsigned("k", shift)
    sorted_ = shared.repartition(shard).sortWithinPartitions(shard)
    index = save(sorted_.mapInArrow(_built(shift), INDEX), "line-index")
    free(shared)
    return index, shift


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """All rows and columns, with the text's repeated lines dropped, and ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``least`` code points and stands in at least ``copies`` rows stays only in the rows
    with the least id that holds it, there as often as it did.  Rows that repeat an id all count as its rows.  A null id is the greatest; a null or empty text has one line,
    which is too short to count, and stays as it is.  Texts of any length are split whole.  An empty table stays empty.  Columns
    called n_lines or n_dropped are replaced.  Keys are compared by 64-bit hashes and 48-bit fingerprints.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index, shift = line_index(docs, doc, text, least, copies)
    groups, rows, size = [], [], 0
    for row in index.orderBy("shard").toLocalIterator():
        weight = sum(len(row[x]) for x in ("bits", "low", "high", "documents", "least")) + 8 * len(row["bits"]) // 8
        if rows and size + weight > GROUP:
            groups.append(spark.sparkContext.broadcast(Index.of(rows, shift)))
            rows, size = [], 0
        rows.append(row)
        size += weight
    if rows:
        groups.append(spark.sparkContext.broadcast(Index.of(rows, shift)))
    free(index)
    names = [x for x in docs.columns if x not in ("n_lines", "n_dropped")]
    own, (d, t) = numbered(docs.select(*names), doc, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", _lines long, _gone long"
    out = own.mapInArrow(_cleaned(groups, own.columns.index(d), own.columns.index(t), pa.string(), least, copies), schema)
    return out.toDF(*names, "n_lines", "n_dropped")
