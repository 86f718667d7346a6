"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one ``failed`` bit per rule, so that a policy (a named, versioned set of
rules that reject) is a bitwise AND, and an ablation (what would change if one
rule were dropped) is an aggregate over the distinct bit patterns.  No step
shuffles the documents: the ledger is a projection of the scan, and ablations
pre-aggregate to at most ``2 ** rules`` rows per task.

Defined results: a null text counts as an empty one (no words, every
measurement 0); repeated rows and null ids are judged row by row; an empty
table gives an empty ledger; texts of any length are measured whole.  Extra columns are kept in front of the ledger's; ``ledger``
replaces a column of the input that has a ledger column's name, ``kept`` returns
all columns of the input as they were.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import SPACE, let, numbered, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a Column over the measurements, true where the rule fails."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of the named rules."""

    name: str
    version: int
    rejects: tuple[str, ...]


def _repeat_words(hashes: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text.

    Windows are hashed by doubling, from 1 word over 2 and 4 to 8.  A text whose
    4-word windows all differ has no repeated 8-word window and stops there.
    """

    def doubled(h: Column, k: int) -> Column:
        rest = F.size(h) - k
        return F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(k + 1), rest), lambda x, y: F.xxhash64(x, y))

    def differ(h: Column) -> Column:
        return F.size(F.array_distinct(h)) == F.size(h)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated_starts(found: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(found, j)["h"] == s["h"], F.lit(False))
        twice = F.filter(found, lambda s, j: same(s, j - 1) | same(s, j + 1))
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    def count(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(differ(windows), F.lit(0)).otherwise(let(let(by_hash, repeated_starts), covered))

    def of_fours(fours: Column) -> Column:
        return F.when(differ(fours), F.lit(0)).otherwise(let(doubled(fours, 4), count))

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(let(doubled(hashes, 1), lambda h: doubled(h, 2)), of_fours))


def measure(df: DataFrame, text_col: str) -> DataFrame:
    """Add the measurements that rules read, each computed once, to a table of numbered columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def of_hashes(h: Column) -> Column:
        stutters = F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False))))
        return F.struct(_repeat_words(h).cast("long").alias("n_repeat_words"), stutters.cast("long").alias("n_stutters"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("h"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    measured = df.withColumn("w", let(words_of(text), of_words)).withColumn("l", let(lines, of_lines))
    return measured.withColumns(
        {
            "n_words": F.col("w.n_words"),
            "word_chars": F.col("w.word_chars"),
            "n_repeat_words": F.col("w.h.n_repeat_words"),
            "n_stutters": F.col("w.h.n_stutters"),
            "n_lines": F.col("l.n_lines"),
            "n_dup_lines": F.col("l.n_dup_lines"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_shouts": F.regexp_count(text, F.lit("!!")).cast("long"),
        }
    ).drop("w", "l")


#: Names of the production rules; their order gives the bits, so append only.
NAMES = ("too_short", "repeated_windows", "symbols", "duplicate_lines", "shouting", "stutter", "long_words")


def default_rules() -> list[Rule]:
    """The production rules."""
    c = F.col
    fails = (
        c("n_words") < 20,
        100 * c("n_repeat_words") > 30 * c("n_words"),
        100 * c("n_symbols") > 20 * c("n_words"),
        (c("n_dup_lines") >= 3) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        100 * c("n_shouts") > 20 * c("n_words"),
        100 * c("n_stutters") > 30 * c("n_words"),
        c("word_chars") > 20 * c("n_words"),
    )
    return [Rule(n, f) for n, f in zip(NAMES, fails, strict=True)]


BASE = ("too_short", "repeated_windows")
POLICIES = (
    Policy("base", 1, BASE),
    Policy("web", 1, (*BASE, "symbols")),
    Policy("web", 2, (*BASE, "symbols", "duplicate_lines", "shouting", "stutter", "long_words")),
)


def mask_of(rules: list[Rule], names: tuple[str, ...]) -> int:
    """The bits of the named rules; an unknown name is an error."""
    at = {r.name: i for i, r in enumerate(rules)}
    return reduce(lambda m, n: m | 1 << at[n], names, 0)


def _judged(df: DataFrame, text_col: str, rules: list[Rule] | None) -> DataFrame:
    """The numbered columns of ``df``, the measurements and ``failed``."""
    rules = default_rules() if rules is None else rules
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    rows, (text,) = numbered(df, text_col)
    bits = [F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    return measure(rows, text).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def ledger(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Every row with its measurements and ``failed``: bit i is set where rule i fails."""
    book = _judged(df, text_col, rules)
    own = book.columns[len(df.columns) :]
    clear = [i for i, c in enumerate(df.columns) if c.lower() not in own]
    return book.select(*[f"c{i}" for i in clear], *own).toDF(*[df.columns[i] for i in clear], *own)


def kept(df: DataFrame, policy: Policy, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``df`` that pass a policy, with all their columns unchanged."""
    book = _judged(df, text_col, rules).where(passes(policy, rules))
    return book.select(*book.columns[: len(df.columns)]).toDF(*df.columns)


def passes(policy: Policy, rules: list[Rule] | None = None) -> Column:
    """True where a ledger row fails none of the policy's rules."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(default_rules() if rules is None else rules, policy.rejects))) == 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: list[Rule] | None = None) -> DataFrame:
    """Per policy and rule: rows it rejects, rows it alone rejects, rows kept without it.

    The ledger is first counted by bit pattern, so what is shuffled is bounded by
    the number of patterns and not by the number of documents.
    """
    rules = default_rules() if rules is None else rules
    patterns = book.groupBy("failed").agg(F.count("*").alias("rows"))
    cases = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(n).alias("rule"), F.lit(mask_of(rules, p.rejects)).cast("long").alias("mask"), F.lit(mask_of(rules, (n,))).cast("long").alias("bit"))
            for p in policies
            for n in p.rejects
        ]
    )
    seen = patterns.withColumn("case", F.explode(cases)).select("failed", "rows", "case.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    rest = F.col("failed").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))
    total = lambda when, name: F.sum(F.when(when, F.col("rows")).otherwise(0)).alias(name)
    return seen.groupBy("policy", "version", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0, "rejected"), total(hit == F.col("bit"), "rejected_alone"), total(hit == 0, "kept"), total(rest == 0, "kept_without")
    )
