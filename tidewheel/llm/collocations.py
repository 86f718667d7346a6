"""Phrase collocations by language: Misra-Gries summaries find what is frequent, a second pass counts it exactly.

First pass.  Every run of one to four words is a 64-bit hash of its language and
words.  Tasks combine the hashes of a stretch of text by hash partition, and
partitions merge what all tasks have seen of them into a Misra-Gries summary: at
most ``capacity`` counters; when there are more, the largest count beyond capacity is taken off all.
A summary whose capacity exceeds its mass over the threshold loses less than the
threshold of any run, so every frequent one survives.  The mass of a partition
is known before its first summary is read, as the masses are sorted to the front.  Runs that reach
the threshold within one stretch survive at once and add no mass, so common runs load no partition.

Second pass.  A bit table of bounded size over the survivors tells which runs
of the texts to count; these are counted by their words, so a wrong bit only
costs time.  Cuts, scores and the dropping of phrases inside longer ones are
joins over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.scratch import free, save, small_batches
from tidewheel.llm.textkit import chunks, mix, words

#: Parameters: the longest phrase, the least count, the share of a longer phrase's count (per cent) that drops a phrase, phrases returned for each language.
LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Parameters: runs of words held at once by a task, the mass a partition is made for, counters for each threshold of mass, counters merged at once, the most bits of the bit table (64 MB), bits for each survivor, survivors of a bucket of the second pass.
HELD, MASS, ROOM, MERGED, BITS, EACH, BUCKET = 1 << 22, 1 << 23, 4, 1 << 21, 1 << 29, 256, 1 << 15
#: What ends a piece, and what separates words in it.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SCALE = 2_000_000
SCHEMA = "p long, kind int, mass long, keys binary, counts binary"

_end = np.zeros(256, dtype=bool)
_end[list(ENDS)] = True
_break = _end.copy()
_break[list(BLANKS)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


@dataclass(frozen=True)
class Runs:
    """The words of a stretch of text, and for each length the hashes of the runs that begin at each word (valid where ``whole``)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: list[np.ndarray]
    whole: list[np.ndarray]


def runs_of(data: np.ndarray, offsets: np.ndarray, salts: np.ndarray, longest: int = LONGEST) -> Runs:
    """Runs of words that stay in a piece of a text; ``salts`` tells the languages of the texts apart."""
    with np.errstate(over="ignore"):
        h, starts, ends, bounds = words(data, offsets, _break)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        stops = np.flatnonzero(_end[data])
        # A word goes on from the one before if no end of a piece or text is between them.
        joined = np.zeros(len(h), dtype=bool)
        if len(h) > 1:
            joined[1:] = (rows[1:] == rows[:-1]) & (np.searchsorted(stops, ends[:-1]) == np.searchsorted(stops, starts[1:]))
        own = mix(h + salts[rows]) if len(h) else h
        hashes, whole = [own], [np.ones(len(h), dtype=bool)]
        for n in range(1, longest):
            long, fits = np.zeros_like(h), np.zeros(len(h), dtype=bool)
            if len(h) > n:
                long[:-n] = mix(hashes[-1][:-n] * np.uint64(0x9E3779B97F4A7C15) + h[n:])
                fits[:-n] = whole[-1][:-n] & joined[n:]
            hashes.append(long)
            whole.append(fits)
    return Runs(data, starts, ends, rows, hashes, whole)


def _salts(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=np.uint64)


def _stretches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Runs, list[str]]]:
    """(runs, languages of the texts) of (text, lang)."""
    for batch in batches:
        langs = ["und" if x is None else x for x in batch.column(1).to_pylist()]
        for at, data, offsets in chunks(batch.column(0)):
            own = langs[at : at + len(offsets) - 1]
            yield runs_of(data, offsets, _salts(own), longest), own


def packed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as their differences, bytes of equal weight together, compressed."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="lz4", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, 4 * n, codec="lz4", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(flat.T).view("<u4").ravel(), dtype=np.uint32)


def _rows(*columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["p", "kind", "mass", "keys", "counts"])


def _summed(shift: int, least: int, longest: int) -> Callable:
    """Rows of a partition p: kind 0 its mass in a stretch, 1 the runs that survive at once, 2 the other runs and their counts.

    A key is the hash without its last bits; 32 bits of it stand below the partition's number.
    """

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        keys.sort()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[at], np.diff(np.append(at, len(keys)))
        p = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k, n = keys[a:b].astype(np.uint32), counts[a:b]
            sure, few = k[n >= least], n[n < least]
            for kind, size, x, y in ((0, int(few.sum()), b"", b""), (1, len(sure), packed(sure) if len(sure) else b"", b""), (2, len(few), packed(k[n < least]) if len(few) else b"", pa.compress(few.astype(np.uint32).tobytes(), codec="lz4", asbytes=True) if len(few) else b"")):
                if size:
                    for column, v in zip(out, (int(p[a]), kind, size, x, y), strict=True):
                        column.append(v)
        yield _rows(*out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for own, _ in _stretches(batches, longest):
            for h, whole in zip(own.hashes, own.whole, strict=True):
                held.append(h[whole] >> np.uint64(shift))
                size += len(held[-1])
            if size >= HELD:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    return summed


@dataclass
class Summary:
    """A Misra-Gries summary: counts are at most ``lost`` below the truth."""

    capacity: int
    keys: np.ndarray
    counts: np.ndarray
    lost: int = 0

    @classmethod
    def empty(cls, capacity: int) -> Summary:
        return cls(capacity, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Add the counts, and take the largest count beyond capacity off all if there are more counters."""
        k, n = np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts])
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
        self.keys, self.counts = (k[at], np.add.reduceat(n, at)) if len(at) else (k, n)
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stays = self.counts > off
            self.keys, self.counts, self.lost = self.keys[stays], self.counts[stays] - off, self.lost + off

    def survivors(self, least: int) -> np.ndarray:
        """All that may have been seen ``least`` times."""
        return self.keys[self.counts + self.lost >= least]


def _surviving(least: int) -> Callable:
    """The keys of every partition that may be frequent; rows come by partition and kind."""

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda p, k: pa.RecordBatch.from_arrays([pa.array((np.int64(p) << 32) + np.unique(k).astype(np.int64))], ["key"])
        now, mass, sure, held, size, room = None, 0, [], [], 0, None

        def merged() -> None:
            nonlocal held, size
            room.merge([k for k, _ in held], [n for _, n in held])
            held, size = [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                merged()
            found = [*sure, *([room.survivors(least)] if room else [])]
            if found:
                yield out(now, np.concatenate(found))

        for batch in batches:
            ps, kinds, masses = (batch.column(i).to_pylist() for i in range(3))
            for i, (p, kind, n) in enumerate(zip(ps, kinds, masses, strict=True)):
                if p != now:
                    if now is not None:
                        yield from ended()
                    now, mass, sure, held, size, room = p, 0, [], [], 0, None
                if kind == 0:
                    mass += n
                    continue
                keys = unpacked(batch.column(3)[i].as_py(), n)
                if kind == 1:
                    sure = [np.unique(np.concatenate([*sure, keys]))]
                    continue
                room = room or Summary.empty(ROOM * (mass // least + 1))
                held.append((keys, np.frombuffer(pa.decompress(batch.column(4)[i].as_py(), 4 * n, codec="lz4", asbytes=True), dtype=np.uint32).astype(np.int64)))
                size += len(keys)
                if size >= MERGED:
                    merged()
        if now is not None:
            yield from ended()

    return surviving


def survivors(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, int]:
    """The saved (key) of all runs of (text, lang) that may be frequent, and the bits by which a hash is shifted to its key."""
    spark = texts.sparkSession
    small_batches(spark)
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # A word and its separator have two bytes at least: the mass is at most 2 * longest * size / 4.
    bits = max(4, (longest * size // 2 // MASS).bit_length())
    parts = texts.mapInArrow(_summed(32 - bits, least, longest), SCHEMA).repartition(1 << bits, "p").sortWithinPartitions("p", "kind")
    return save(parts.mapInArrow(_surviving(least), "key long"), "phrases-survivors"), 32 - bits


def _bit_table(keys: DataFrame, shift: int, n: int) -> tuple[np.ndarray, int]:
    """Bits of the n survivors by the first bits of their hashes, and the bits by which a hash is shifted.  At most BITS bits reach the driver."""
    width = min(BITS.bit_length() - 1, max(20, (EACH * n).bit_length()), 64 - shift)
    at = F.shiftrightunsigned("key", 64 - shift - width) + 1  # the functions number values from 1
    made = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = np.zeros(max(4096, 1 << width >> 3), dtype=np.uint8)
    for row in made.toLocalIterator():
        start = (row["bucket"] - 1) * 4096
        table[start : start + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return table, 64 - width


def zipped(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unzipped(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


COUNTS = "bucket long, lang string, n int, size int, phrases binary, counts binary"


def _counted(table, shift: int, longest: int, bits: int) -> Callable:
    """The runs whose bits are set, in order, and their counts, together by hash bucket and language; the empty phrase counts all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_, totals, held = table.value, {}, {}

        def out() -> pa.RecordBatch:
            # The empty phrase has bucket 0.
            rows = sorted([*((key >> 64 - bits, *v) for key, v in held.items()), *((0, x, b"", n) for x, n in totals.items())])
            totals.clear()
            held.clear()
            cuts = [i for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]
            columns: list[list] = [[], [], [], [], [], []]
            for i, j in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                text = b"\n".join([r[2] for r in rows[i:j]])  # a line feed ends a piece, so no phrase has one
                counts = np.array([r[3] for r in rows[i:j]], dtype="<i8")
                for column, v in zip(columns, (*rows[i][:2], j - i, len(text), zipped(text), zipped(counts.tobytes())), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "lang", "n", "size", "phrases", "counts"])

        for own, langs in _stretches(batches, longest):
            for x, n in zip(langs, np.bincount(own.rows, minlength=len(langs)).tolist(), strict=True):
                totals[x] = totals.get(x, 0) + n
            lowered, shorter = _lower[own.data].tobytes(), None
            for width, (h, fits) in enumerate(zip(own.hashes, own.whole, strict=True), 1):
                if shorter is not None:  # the runs inside a frequent run are frequent
                    fits = fits & shorter
                    fits[:-1] &= shorter[1:]
                at = np.flatnonzero(fits)
                place = h[at] >> np.uint64(shift)
                at = at[(set_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                shorter = np.zeros(len(h), dtype=bool)
                shorter[at] = True
                keys, first, counts = np.unique(h[at], return_index=True, return_counts=True)
                for key, i, n in zip(keys.tolist(), at[first].tolist(), counts.tolist(), strict=True):
                    if seen := held.get(key):
                        seen[2] += n
                    else:
                        held[key] = [langs[own.rows[i]], b" ".join([lowered[own.starts[i + j] : own.ends[i + j]] for j in range(width)]), n]
            if len(held) > HELD >> 4:
                yield out()
        if totals:
            yield out()

    return counted


def _added(least: int) -> Callable:
    """(lang, phrase, f) of all phrases seen ``least`` times; rows come by bucket and language, so one bucket's phrases are held at a time."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def out() -> pa.RecordBatch:
            kept = [(p, n) for p, n in sums.items() if n >= least or not p]
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(kept), type=pa.string()), pa.array([p for p, _ in kept], type=pa.string()), pa.array([n for _, n in kept], type=pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != now:
                    if now is not None:
                        yield out()
                    now, sums = key, {}
                n, size, text, counts = (batch.column(j)[i].as_py() for j in range(2, 6))
                phrases = unzipped(text, size).decode().split("\n")
                for p, k in zip(phrases, np.frombuffer(unzipped(counts, 8 * n), dtype="<i8").tolist(), strict=True):
                    sums[p] = sums.get(p, 0) + k
        if now is not None:
            yield out()

    return added


def frequent_runs(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """The saved (lang, phrase, words, f): every run of words seen ``least`` times in its language, with its exact count, and the count of all words as the empty phrase.

    Runs of one batch are told apart by 64-bit hashes, those of all batches by their words.
    """
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    keys, shift = survivors(texts, least, longest)
    n = keys.count()
    table, at = _bit_table(keys, shift, n)
    free(keys)
    bits = max(4, (n // BUCKET).bit_length())
    held = texts.sparkSession.sparkContext.broadcast(table)
    parts = texts.mapInArrow(_counted(held, at, longest, bits), COUNTS).repartition(1 << bits, "bucket", "lang").sortWithinPartitions("bucket", "lang")
    found = parts.mapInArrow(_added(least), "lang string, phrase string, f long")
    width = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return save(found.select("lang", "phrase", width.alias("words"), "f"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int | None = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language by score, then count, then bytes.

    A phrase has two words or more, all in one piece of a text, and is seen at least ``least`` times.  It is cut into a first part (seen l times) and a rest (r):
    the cut with the least floor(2,000,000 a / (l + r)) counts, of equal ones the first.  A phrase inside a longer frequent one
    that is seen at least ``share`` per cent as often is dropped.  ``top`` None returns all.  Null texts are empty, and empty texts have no
    words; a null language is ``und``; repeated rows count again; texts of any length are read whole.  An empty table gives no rows.
    """
    return scored(frequent_runs(docs, least, longest, text, lang), longest, share, top)


def scored(runs: DataFrame, longest: int = LONGEST, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """The collocations of frequent runs (lang, phrase, words, f); see ``collocations``."""
    whole, parts = runs.where("words >= 2"), runs.where("words >= 1").select("lang", F.col("phrase").alias("part"), "f")
    pieces = F.split("phrase", " ")
    cut = whole.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), pieces.alias("w"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, longest), " ").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(parts.withColumnsRenamed({"part": side, "f": name}), ["lang", side])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    least_cut = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # Every shorter phrase inside a longer one, with the greatest count of those that hold it.
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = whole.where("words > 2").select("lang", "f", "words", pieces.alias("w")).select("lang", F.col("f").alias("longer"), F.explode(inner).alias("phrase"))
    hidden = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least_cut.join(hidden, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    total = runs.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
