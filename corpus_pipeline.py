"""The corpus pipeline: five filtering and packing stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and its output is written and read
again before the next one begins.  All but the last return the columns of
``documents``, whatever they are called, with unchanged values, row by row: repeated rows stay as far as a stage
doesn't take them for copies.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontamination, jaccard_join, packing, quality_rules, toxicity
from tidewheel.llm.scratch import save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Null and empty texts are scored as texts without a word; without labels of both kinds all stay; a score of one half goes.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest quality policy.  Null, empty and short texts fail it."""
    return quality_rules.kept(docs, quality_rules.POLICIES[-1])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The least id stays, a null id counts as greatest; texts without words all stay.
    """
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.  Null and empty texts stay, and all stay if the benchmark is empty."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids: a row for each piece, with its place.  Null and empty texts have the end id alone; only longer documents are cut."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", apply_rules), ("jaccard_join", keep_one), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL cannot express trained scores and subword ids; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
