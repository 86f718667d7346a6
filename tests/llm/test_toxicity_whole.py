"""The toxicity classifier learns from all labelled rows, and its thresholds come from sums over all rows set aside."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tidewheel.llm import toxicity
from tidewheel.llm.scratch import doc_hash

N = 9000


def test_a_word_of_the_last_ids_is_learned(spark):
    """Ids that may be learned from are ranked by their hash: one toxic word is only in those after the 6,000th, one only in the others."""
    ids = spark.range(N).withColumnRenamed("id", "doc_id").withColumn("learned", doc_hash("doc_id") % 5 != 0)
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("learned").orderBy(F.xxhash64("doc_id"))))
    late = F.when(F.col("learned"), F.col("nth") > 6000).otherwise(F.col("doc_id") % 8 == 0)
    word = F.when(F.col("doc_id") % 4 == 0, F.when(late, "qqworse").otherwise("zzbad")).otherwise("mild")
    docs = ids.select("doc_id", F.concat_ws(" ", F.concat(F.lit("w"), F.col("doc_id") % 17), word, F.concat(F.lit("v"), F.col("doc_id") % 23)).alias("text"), F.lit("en").alias("lang"))
    labels = ids.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.scores(docs, labels).join(ids.where("not learned").select("doc_id"), "doc_id").join(docs, "doc_id").collect()
    kinds = {w: [r["score"] for r in got if w in r["text"]] for w in ("qqworse", "zzbad", "mild")}
    assert min(map(len, kinds.values())) > 100
    assert min(kinds["qqworse"]) >= 0.5 and min(kinds["zzbad"]) >= 0.5 and max(kinds["mild"]) < 0.5


def test_cuts_against_the_plain_form(spark):
    rng = np.random.default_rng(3)
    lang, logit = rng.integers(0, 3, 400), np.round(rng.normal(size=400), 1)
    toxic = (logit + rng.normal(size=400) > 1).astype(int)
    toxic[lang == 2] = 0
    found = spark.createDataFrame(list(zip(lang.tolist(), logit.tolist(), toxic.tolist(), strict=True)), "lang int, logit double, toxic int").repartition(5)
    got = toxicity.best_cuts(found)
    for x in (-1, 0, 1):
        own = (lang == x) | (x == -1)
        assert got[x] == (pytest.approx(toxicity.Model._best(logit[own], toxic[own], 9.0)), toxic[own].sum(), own.sum())
    assert got[2][1] == 0


def test_the_driver_gets_averages_in_single_precision(spark, monkeypatch):
    """Two rounds bring the model once with its sums of squares and once without, four bytes a number, and words by language."""
    got = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: [got.append(sum(len(x) for x in r if isinstance(x, bytes | bytearray))) or r for r in collect(self)])
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    assert toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))) is not None
    rows, languages, rest = 1 << toxicity.BITS, 2 * 8 << 15, 1 << 16
    assert 0 < sum(got) <= 4 * rows * (3 * toxicity.DIM + 2) + languages + rest


def test_averages_of_parts():
    """A row counts the parts that have met it; what none has met stays."""
    cnn = toxicity.Cnn(np.random.default_rng(1))
    before, size, width = cnn.table.copy(), (1 << toxicity.BITS) // toxicity.BLOCKS, toxicity.DIM + 1
    total = np.zeros((toxicity.BLOCKS, size, width))
    total[1, 5] = [3.0] * toxicity.DIM + [2]
    rest = np.concatenate([x.ravel() for x in cnn.rest()]).astype(float)
    found = {f"table {k}": x.ravel() for k, x in enumerate(total)} | {"rest": np.append(rest * 3, 3)}
    toxicity._averaged(cnn, {n: np.frombuffer(toxicity._mean(n, x, width).tobytes(), dtype="<f4") for n, x in found.items()})
    before[size + 5] = 1.5
    assert np.array_equal(cnn.table, before)
    assert np.allclose(np.concatenate([x.ravel() for x in cnn.rest()]), rest)
