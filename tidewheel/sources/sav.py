"""SPSS system files (.sav) as a Spark data source: ``read_sav``, or format "sav" after registering ``SavSource``.

The layout is the one that the PSPP developers have published.  A file's dictionary gives the columns; its cases are read in
ranges, each a partition, as Arrow batches.  Cases without compression have a fixed size; those with byte codes have not, so
planning runs over the codes once, without their values, to find where ranges begin.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DataType, DateType, DoubleType, StringType, StructField, StructType, TimestampNTZType

from tidewheel.sources.files import listed, located

#: Parameters: cases of a partition, and of a batch.
CASES, BATCH = 1 << 18, 1 << 12
#: Print formats of days and of moments, and the day from which both count seconds.
DAYS, MOMENTS = (20, 23, 24, 38, 39), (22, 41)
EPOCH = datetime(1582, 10, 14)
#: The codes of compressed cases.
SKIP, LAST, RAW, BLANK, MISSING = 0, 252, 253, 254, 255


@dataclass
class Variable:
    """A column: its place among the 8-byte elements of a case, width in bytes (0: a number), what counts as missing, and labels."""

    short: str
    at: int
    width: int
    format: int
    name: str = ""
    label: str | None = None
    missing: tuple[float, ...] = ()
    low: float | None = None
    high: float | None = None
    labels: dict = field(default_factory=dict)
    pieces: list[tuple[int, int]] = field(default_factory=list)

    @property
    def type(self) -> DataType:
        return StringType() if self.width else DateType() if self.format in DAYS else TimestampNTZType() if self.format in MOMENTS else DoubleType()


@dataclass
class Dictionary:
    """What stands before the cases: variables, elements of a case, byte order, compression (0, 1 or 2), bias, the missing number, and where the cases begin."""

    variables: list[Variable]
    elements: int
    order: str
    compression: int
    bias: float
    missing: float
    cases: int
    start: int
    encoding: str


def dictionary(f: BinaryIO) -> Dictionary:
    """The dictionary of an open file."""
    head = f.read(176)
    if head[:4] not in (b"$FL2", b"$FL3"):
        raise ValueError("not a system file")
    order = "<" if struct.unpack("<i", head[64:68])[0] in (2, 3) else ">"
    number = lambda kind, n=4: struct.unpack(order + kind, f.read(n))[0]
    elements, compression, _, cases = struct.unpack(order + "4i", head[68:84])
    bias = struct.unpack(order + "d", head[84:92])[0]
    own: list[Variable] = []
    places: dict[int, Variable] = {}
    sets: list[tuple[list, list[int]]] = []
    sizes, names, missing, encoding, at = {}, {}, -np.finfo(float).max, "utf-8", 0
    while True:
        kind = number("i")
        if kind == 2:
            width, labelled, n_missing, shown, _ = struct.unpack(order + "5i", f.read(20))
            short = f.read(8)
            v = Variable(short.decode("ascii", "replace").rstrip(), at, max(width, 0), shown >> 16 & 255)
            if labelled:
                size = number("i")
                v.label = f.read((size + 3) // 4 * 4)[:size]
            values = [f.read(8) for _ in range(abs(n_missing))]
            if not width and n_missing:
                nums = [struct.unpack(order + "d", x)[0] for x in values]
                if n_missing < 0:
                    v.low, v.high, nums = nums[0], nums[1], nums[2:]
                v.missing = tuple(nums)
            if width >= 0:
                own.append(v)
                places[at + 1] = v
            at += 1
        elif kind == 3:
            values = []
            for _ in range(number("i")):
                value, size = f.read(8), f.read(1)[0]
                values.append((value, f.read((size + 8) // 8 * 8 - 1)[:size]))
            if number("i") != 4:
                raise ValueError("value labels without variables")
            sets.append((values, [number("i") for _ in range(number("i"))]))
        elif kind == 6:
            f.read(80 * number("i"))
        elif kind == 7:
            sub, size, count = struct.unpack(order + "3i", f.read(12))
            data = f.read(size * count)
            if sub == 4 and size == 8:
                missing = struct.unpack(order + "d", data[:8])[0]
            elif sub in (13, 14):
                pairs = dict(p.split(b"=", 1) for p in data.rstrip(b"\0\t").split(b"\t") if b"=" in p)
                (names if sub == 13 else sizes).update({k.decode("ascii", "replace").strip(): v.rstrip(b"\0") for k, v in pairs.items()})
            elif sub == 20:
                encoding = data.decode("ascii").strip("\0 ") or encoding
        elif kind == 999:
            f.read(4)
            break
        else:
            raise ValueError(f"unknown record {kind}")
    text = lambda b: b.decode(encoding, "replace")
    for v in own:
        v.name = text(names[v.short]) if v.short in names else v.short
        v.label = None if v.label is None else text(v.label)
        v.pieces = [(v.at, v.width)]
    for values, where in sets:
        for place in where:
            v = places[place]
            v.labels = {(text(x).rstrip() if v.width else struct.unpack(order + "d", x)[0]): text(y) for x, y in values}
    # Strings above 255 bytes are several variables, of which the first has the name.
    kept, i = [], 0
    while i < len(own):
        v, n = own[i], 1
        if v.short in sizes and v.width:
            size = int(sizes[v.short])
            n = (size + 251) // 252
            v.pieces = [(p.at, min(255 if j < n - 1 else p.width, p.width)) for j, p in enumerate(own[i : i + n])]
            v.width = size
        kept.append(v)
        i += n
    return Dictionary(kept, at, order, compression, bias, missing, cases, f.tell(), encoding)


@dataclass
class Range(InputPartition):
    """Cases of a file: from byte ``start`` (after ``skip`` codes of that block), ``cases`` of them or, if None, all."""

    path: str
    start: int
    skip: int
    cases: int | None


def _blocks(f: BinaryIO, d: Dictionary) -> Iterator[bytes]:
    """The bytes of the case data, without the streams that a compression of 2 puts around them."""
    if d.compression != 2:
        while block := f.read(1 << 20):
            yield block
        return
    _, end, _ = struct.unpack(d.order + "3q", f.read(24))
    engine = zlib.decompressobj()
    while raw := engine.unused_data or f.read(min(1 << 20, end - f.tell())):
        if engine.eof:  # each block is a stream of its own
            engine = zlib.decompressobj()
        yield engine.decompress(raw)


def _codes(f: BinaryIO, d: Dictionary, skip: int = 0) -> Iterator[bytes | float | None]:
    """The elements of compressed cases: 8 bytes, a number, or None for a missing one."""
    held, at, blocks = b"", 0, _blocks(f, d)

    def eight() -> bytes:
        nonlocal held, at
        while len(held) - at < 8:
            more = next(blocks, b"")
            if not more:
                return b""
            held, at = held[at:] + more, 0
        at += 8
        return held[at - 8 : at]

    while codes := eight():
        for code in codes[skip:]:
            if code == LAST:
                return
            if code == RAW:
                yield eight()
            elif code == BLANK:
                yield b" " * 8
            elif code == MISSING:
                yield None
            elif code != SKIP:
                yield code - d.bias
        skip = 0


def _ranges(path: str) -> Iterator[Range]:
    system, at = located(path)
    with system.open_input_file(at) as f:
        d = dictionary(f)
        if d.compression == 0:
            size = 8 * d.elements
            total = (f.size() - d.start) // size if size else 0
            for first in range(0, total, CASES):
                yield Range(path, d.start + first * size, 0, min(CASES, total - first))
            return
        if d.compression == 2 or 0 <= d.cases <= CASES:
            yield Range(path, d.start, 0, None)
            return
        # Codes only: where does every so many-th case begin?
        place, seen, begin, skip = d.start, 0, d.start, 0
        f.seek(place)
        whole = CASES * d.elements
        while codes := f.read(8):
            raw = codes.count(RAW)
            ends = LAST in codes
            for k, code in enumerate(codes):
                if code not in (SKIP, LAST):
                    seen += 1
                    if seen == whole:
                        yield Range(path, begin, skip, CASES)
                        seen, begin, skip = 0, place, k + 1
                if code == LAST:
                    break
            place += 8 + 8 * raw
            if ends:
                break
            f.seek(place)
        if seen:
            yield Range(path, begin, skip, seen // d.elements)


class SavReader(DataSourceReader):
    """Reads ranges of cases as Arrow batches."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[Range]:
        return [r for p in listed(self.path, ".sav") for r in _ranges(self.path if p == located(self.path)[1] else p)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, at = located(partition.path)
        with system.open_input_file(at) as f:
            d = dictionary(f)
            f.seek(partition.start)
            for case in self._cases(f, d, partition):
                yield self._batch(case, d)

    def _cases(self, f: BinaryIO, d: Dictionary, part: Range) -> Iterator[np.ndarray]:
        """Blocks of cases as (case, element) 8-byte items."""
        left = part.cases
        if d.compression == 0:
            while left:
                n = min(left, BATCH)
                yield np.frombuffer(f.read(8 * n * d.elements), dtype="V8").reshape(n, d.elements)
                left -= n
            return
        pack, absent = struct.Struct(d.order + "d").pack, struct.pack(d.order + "d", d.missing)
        held: list[bytes] = []
        # A range begins within a block of codes: the raw values of the codes before it come first.
        if part.skip:
            codes = f.read(8)
            f.seek(part.start + 8 + 8 * codes[: part.skip].count(RAW))
            elements = self._rest(f, d, codes[part.skip :])
        else:
            elements = _codes(f, d)
        for x in elements:
            held.append(absent if x is None else x if isinstance(x, bytes) else pack(x))
            if len(held) == BATCH * d.elements or (left is not None and len(held) == left * d.elements):
                n = len(held) // d.elements
                yield np.frombuffer(b"".join(held), dtype="V8").reshape(n, d.elements)
                held = []
                if left is not None:
                    left -= n
                    if not left:
                        return
        if n := len(held) // d.elements if d.elements else 0:
            yield np.frombuffer(b"".join(held[: n * d.elements]), dtype="V8").reshape(n, d.elements)

    @staticmethod
    def _rest(f: BinaryIO, d: Dictionary, codes: bytes) -> Iterator[bytes | float | None]:
        for code in codes:
            if code == LAST:
                return
            if code == RAW:
                yield f.read(8)
            elif code != SKIP:
                yield b" " * 8 if code == BLANK else None if code == MISSING else code - d.bias
        yield from _codes(f, d)

    def _batch(self, case: np.ndarray, d: Dictionary) -> pa.RecordBatch:
        columns = []
        for v in d.variables:
            if v.width:
                own = [(case[:, a : a + (w + 7) // 8].tobytes(), (w + 7) // 8 * 8, w) for a, w in v.pieces]
                raw = (b"".join(x[i * size : i * size + w] for x, size, w in own) for i in range(len(case)))
                columns.append(pa.array([r.decode(d.encoding, "replace").rstrip(" ") for r in raw], type=pa.string()))
                continue
            x = np.ascontiguousarray(case[:, v.at]).view(d.order + "f8").astype(float)
            gone = (x == d.missing) | np.isin(x, v.missing)
            if v.low is not None:
                gone |= (x >= v.low) & (x <= v.high)
            if isinstance(v.type, DoubleType):
                columns.append(pa.array(x, mask=gone))
            else:
                moments = [None if g else EPOCH + timedelta(seconds=float(s)) for s, g in zip(x, gone, strict=True)]
                columns.append(pa.array([m and date(m.year, m.month, m.day) for m in moments], type=pa.date32()) if isinstance(v.type, DateType) else pa.array(moments, type=pa.timestamp("us")))
        return pa.RecordBatch.from_arrays(columns, [v.name for v in d.variables])


class SavSource(DataSource):
    """Option ``path``: a file, or a folder of .sav files with the same variables."""

    @classmethod
    def name(cls) -> str:
        return "sav"

    def schema(self) -> StructType:
        return StructType([StructField(v.name, v.type) for v in described(self.options["path"]).variables])

    def reader(self, schema: StructType) -> SavReader:
        return SavReader(self.options["path"], schema)


def described(path: str) -> Dictionary:
    """The dictionary of a file, or of the first .sav file of a folder."""
    files = listed(path, ".sav")
    if not files:
        raise FileNotFoundError(f"no .sav file in {path}")
    system, _ = located(path)
    with system.open_input_file(files[0]) as f:
        return dictionary(f)


def read_sav(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a system file.  Labels are metadata of their columns: ``comment`` the variable's, ``labels`` those of its values.

    Missing numbers, also those that a variable declares missing, are NULL; strings lose their padding; dates and moments are such.
    """
    spark.dataSource.register(SavSource)
    df = spark.read.format("sav").option("path", path).load()
    about = {v.name: {k: x for k, x in (("comment", v.label), ("labels", {str(int(a)) if isinstance(a, float) and a == int(a) else str(a): b for a, b in v.labels.items()})) if x} for v in described(path).variables}
    return df.select(*[F.col("`" + x.replace("`", "``") + "`").alias(x, metadata=about[x]) for x in df.columns])
