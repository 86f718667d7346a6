"""Whole-batch text work in numpy: words, hashes and shingle sets of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd base for word hashes, the splitmix64 constants, and the most bytes handled at once.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII sign that is neither a letter nor a digit separates words, for models that read bare words.
SIGNS = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def plain(texts: pa.Array) -> pa.Array:
    """The texts without nulls, their bytes starting at 0: some Arrow kernels misread others."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about CHUNK bytes; nulls are empty.

    A longer row makes a run of its own, so texts are always whole.
    """
    texts = plain(texts)
    offsets, data = np.frombuffer(texts.buffers()[1], dtype=np.int64), np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """A row of hashes for each size: of the first so many bytes of every word, apart from those of whole words."""
    total = byte_sums(data)
    return np.stack([mix(parts(total, starts, np.minimum(starts + n, ends)) + np.uint64(n)) for n in sizes]) if len(starts) else np.zeros((len(sizes), 0), dtype=np.uint64)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the lower-cased bytes times powers: ``parts`` takes hashes of stretches from them."""
    up, _ = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_lower[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def parts(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the bytes from starts to ends, wherever they stand."""
    return (total[ends] - total[starts]) * _power(len(total))[1][starts]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the A-Z lower-cased words, their byte starts and ends, and the word offsets of the rows."""
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(rows + 1, dtype=np.int64)
    total = byte_sums(data)
    solid = ~breaks[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a row begins here
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix(parts(total, starts, ends)), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct k-word shingle hashes; fewer words make one shingle, none an empty set."""
    n = len(hashes)
    width = np.zeros(max(n, 1), dtype=np.uint64)
    salt = [np.uint64((2 * j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1) for j in range(k)]
    for j in range(k):
        if n > j:
            width[: n - j] += hashes[j:] * salt[j]
    full = mix(width)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            short = np.uint64(b - a)
            for j in range(b - a):
                short = short + hashes[a + j] * salt[j]
            yield mix(np.array([short], dtype=np.uint64))
        else:
            yield full[:0]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of every row, in order."""
    with np.errstate(over="ignore"):
        for _, data, offsets in chunks(texts):
            hashes, _, _, bounds = words(data, offsets)
            yield from shingles(hashes, bounds, k)


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of 64-bit values from one array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), type=kind))
