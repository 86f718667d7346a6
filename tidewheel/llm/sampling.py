"""Bounded samples of rows, and models that are fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A text that takes more than one such part of the bytes allowed is not sampled.
LARGEST = 16


def of_ids(texts: DataFrame, ids: DataFrame, most_bytes: int) -> DataFrame:
    """Whole rows of ``texts`` (doc_id, text, ...) with the named ids, one for each, as far as their texts fit.

    ``ids`` is bounded by its maker.  They are in one partition, in the order of their ids' hashes; of an id with several texts the longest, then the least is taken.
    """
    found = texts.join(F.broadcast(ids), "doc_id").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    fits = found.where(F.col("bytes") <= most_bytes // LARGEST)
    # Copies of an id add nothing.  What is summed up has a row for each id.
    sizes = fits.groupBy("doc_id").agg(F.max("bytes").alias("bytes"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = sizes.withColumn("all", F.sum("bytes").over(upto)).where(F.col("all") <= most_bytes).select("doc_id", "bytes")
    rows = fits.join(F.broadcast(taken), ["doc_id", "bytes"])
    one = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("nth = 1")
    return one.drop("nth", "bytes").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object | None]):
    """What ``fit`` makes of a bounded sample, in one task, so that neither the rows nor the work are the driver's; None without rows."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        made = fit(pa.Table.from_batches(held)) if held else None
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])

    row = sample.mapInArrow(in_task, "model binary").first()
    return pickle.loads(row["model"]) if row else None
