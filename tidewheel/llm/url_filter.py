"""URL filters by a Bloom filter cascade.

A list of keys (a host and a path prefix) is to be looked up for every url
without joins and without errors.  Level 1 of a cascade is a Bloom filter of the
listed keys.  The keys of the corpus that it lets through although they are
not listed are encoded in level 2, the listed keys that level 2 lets through
in level 3, and so on until a level has no false positive.  A key is listed
if the first level that rejects it is an even one, counted from 1, or if all
accept it and their number is odd.  As every key that the corpus can ask for
was checked when the levels were built, answers are exact.

The corpus's key universe is every (host suffix, path prefix) of its urls whose number of labels and whose length
a listed host and path have; the keys are built by
Spark, and levels are built by distributed passes over the distinct keys.  A
level holds ``BITS_A_KEY`` bits for each key that it encodes: the first as many
as are listed, the next a few per cent of the universe.  Filters are handed to all
tasks only while they take at most ``MOST_BYTES``; a larger list is dealt out by key over as many cascades
as it takes, and urls are judged by one after another.

Keys are compared by 64-bit hashes: answers are exact but for a chance of about
(keys of the corpus) x (listed keys) / 2 ** 64 that two of them collide.

Defined results: a null url or one without ``://`` has an empty host and path,
which no rule fits and no list holds; repeated rows and null ids are judged
row by row; of fitting rules of equal length the first counts; very long urls are judged whole, and give no more keys than listed
lengths allow; an empty table gives an empty result; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import LOWER, UPPER, save
from tidewheel.llm.textkit import mix

BITS_A_KEY, HASHES, MOST_BYTES, MOST_LEVELS = 10, 5, 64 << 20, 64


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains if the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, labels: Column) -> Column:
    """The host and those of its parent domains that a listed host can equal.

    labels: the numbers of labels of listed hosts, ascending.
    """
    parts = F.split(host, r"\.")
    fit = F.filter(labels, lambda n: n <= F.size(parts))
    return F.transform(fit, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def prefixes(path: Column, lengths: Column) -> Column:
    """The prefixes of a path that a listed path can equal, shortest first.

    lengths: the lengths of listed paths, ascending.
    """
    fit = F.filter(lengths, lambda n: n <= F.length(path))
    return F.transform(fit, lambda n: F.substring(path, F.lit(1), n))


def keys_of(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """64-bit keys of every pair of a host suffix and a path prefix."""
    heads = prefixes(path, lengths)
    pairs = F.transform(suffixes(host, labels), lambda h: F.transform(heads, lambda p: F.struct(h.alias("host"), p.alias("path"), F.xxhash64(h, p).alias("key"))))
    return F.filter(F.flatten(pairs), lambda x: host != "")


def _places(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(keys.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


@dataclass(frozen=True)
class Cascade:
    """Bloom filters, one bit array a level; listed(keys) is exact over the universe it was built for."""

    levels: tuple[np.ndarray, ...]

    def passed(self, keys: np.ndarray, level: int) -> np.ndarray:
        bits = np.unpackbits(self.levels[level], bitorder="little") if len(self.levels[level]) < 1 << 12 else None
        at = _places(keys, len(self.levels[level]) * 8, level)
        if bits is not None:
            return bits[at].all(axis=1)
        return ((self.levels[level][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), len(self.levels) % 2 == 1), np.arange(len(keys))
        for level in range(len(self.levels)):
            ok = self.passed(keys[open_], level)
            out[open_[~ok]] = level % 2 == 1
            open_ = open_[ok]
        return out


def _encode(bits: int, level: int) -> Callable:
    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(bits, dtype=bool)
        for p in parts:
            table[_places(p["key"].to_numpy(), bits, level).astype(np.int64).ravel()] = True
        if table.any():
            yield pd.DataFrame({"bits": [np.packbits(table, bitorder="little").tobytes()]})

    return encode


def _through(cascade, level: int) -> Callable:
    def through(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[cascade.value.passed(p["key"].to_numpy(), level)]

    return through


def _merge(filters: Iterator[bytes]) -> np.ndarray | None:
    total = None
    for x in filters:
        own = np.frombuffer(x, dtype=np.uint8)
        total = own if total is None else total | own
    return total


class TooLarge(ValueError):
    """The filters of a cascade would take more than MOST_BYTES."""


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` over ``universe`` (each a column ``key`` of distinct 64-bit keys)."""
    spark = listed.sparkSession
    inside = save(listed.select("key").distinct(), "listed")
    outside = universe.select("key").distinct().join(inside, "key", "left_anti")
    levels: list[np.ndarray] = []
    encoded, other = inside, save(outside, "universe")
    for level in range(MOST_LEVELS):
        n = encoded.count()
        if not n:
            break
        bits = -(-max(n * BITS_A_KEY, 64) // 8) * 8
        if bits // 8 + sum(map(len, levels)) > MOST_BYTES:
            raise TooLarge(f"the list needs more than {MOST_BYTES} bytes of filters")
        rows = encoded.mapInPandas(_encode(bits, level), "bits binary").toLocalIterator()
        levels.append(_merge(r["bits"] for r in rows))
        found = spark.sparkContext.broadcast(Cascade(tuple(levels)))
        let_through = save(other.mapInPandas(_through(found, level), other.schema), "let-through")
        found.destroy()
        encoded, other = let_through, encoded
    else:
        raise ValueError("the cascade did not end")
    return Cascade(tuple(levels))


def _held(cascade, groups: int, group: int):
    @F.pandas_udf("array<boolean>")
    def held(keys: pd.Series) -> pd.Series:
        if not len(keys):
            return pd.Series([], dtype=object)
        sizes = keys.map(len).to_numpy()
        flat = np.concatenate(keys.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, dtype=np.int64)
        return pd.Series(np.split(cascade.value.listed(flat) & (flat % groups == group), np.cumsum(sizes)[:-1]))

    return held


def _looked_up(asked: DataFrame, listed: DataFrame, universe: DataFrame) -> DataFrame:
    """Add ``held`` to (keys, ...): which of the keys are listed.  Keys are dealt out over as many cascades as it takes."""
    spark, groups = asked.sparkSession, 1
    while True:
        out, part = asked, lambda df, g: df.where(F.pmod("key", F.lit(groups)) == g)  # noqa: B023
        try:
            for group in range(groups):
                cascade = spark.sparkContext.broadcast(build(part(listed, group), part(universe, group)))
                found = _held(cascade, groups, group)(F.col("keys.key"))
                out = out.withColumn("held", F.zip_with("held", found, lambda x, y: x | y) if group else found)
                if groups > 1:  # the filters of one group go before the next one's come
                    out = save(out, "held")
                    cascade.destroy()
            return out
        except TooLarge:
            groups *= 2


def judge_urls(pages: DataFrame, rules: list[Rule], blocked_hosts: tuple[str, ...] | DataFrame = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (the longest that fits, else null), verdict.

    ``blocked_hosts`` are further listed keys, given as names or as a table with a column ``host``: hosts blocked whole if no rule fits.
    """
    spark = pages.sparkSession
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    ruled = spark.createDataFrame([(r.host, r.path) for r in rules], "host string, path string")
    table = ruled.unionByName(blocked_hosts.select("host", F.lit("").alias("path"))).where("host is not null")
    # Listed hosts have few numbers of labels and paths few lengths; only such suffixes and prefixes can be listed.
    size = table.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    labels, lengths = (F.array(*map(F.lit, size[x])).cast("array<int>") for x in ("labels", "lengths"))
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keys = keys_of(F.col("host"), F.col("path"), labels, lengths)
    universe = split.select("host", "path").distinct().select(F.explode(keys["key"]).alias("key"))
    found = _looked_up(split.withColumn("keys", keys), table.select(F.xxhash64("host", "path").alias("key")), universe)
    fits = F.filter(F.arrays_zip("keys", "held"), lambda x: x["held"])
    names = F.transform(fits, lambda x: F.concat(x["keys"]["host"], x["keys"]["path"]))
    own = {r.name: r.verdict for r in rules}
    by_length = F.filter(names, lambda x: x.isin(list(own)))
    longest = F.reduce(by_length, F.lit("").cast("string"), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    rule = F.nullif(longest, F.lit(""))
    by_rule = F.try_element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), rule) if own else F.lit(None).cast("string")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, F.when(F.size(names) > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
