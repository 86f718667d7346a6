"""Durable intermediate tables and small helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regex class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session may leave it out, as tests do, and gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-tidewheel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    The table outlives any executor, and unlike a cached one is not recomputed
    when an executor goes away.  ``free`` takes it away.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewheel/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Delete saved tables of which every reader has been written or collected."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns renamed to c0, c1, ..., and the new names of the wanted ones.

    What an operator adds can't clash with these, whatever the caller's columns
    are called; ``toDF(*df.columns)`` gives the names back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(x)}" for x in wanted]


#: Rows that a Python worker gets at once, at most: texts are long, and so few of them fill a batch.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to TEXT_ROWS rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def doc_hash(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")
