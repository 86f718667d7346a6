"""Table readers and the binding of tables to the event schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.sav import read_sav


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder with a header; types by ``schema``, else inferred in one more pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, replacing one that is there."""
    df.write.mode("overwrite").option("header", True).csv(path)


@dataclass(frozen=True)
class Source:
    """Where a table lies (None: nowhere yet), its format, and the columns that are made times, numbers or renamed.

    What can't be read as a time or a number becomes NULL.
    """

    path: str | None
    format: str = "parquet"
    schema: str | None = None
    times: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    renamed: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)


@dataclass
class Catalog:
    """Named tables of a study, such as episodes, baseline, outcomes and validation; each is read when it is first asked for."""

    spark: SparkSession
    sources: dict[str, Source]
    persist: bool = False
    _held: dict[str, DataFrame] = field(default_factory=dict)

    def load(self, name: str, use_cache: bool = True) -> DataFrame:
        """The table, with its types coerced; the same one for the next reader unless ``use_cache`` is False.  Its rows are kept by Spark only in a catalog that persists."""
        if use_cache and name in self._held:
            return self._held[name]
        source = self.sources[name]
        if not source.path:
            raise ValueError(f"the path of {name!r} is not set")
        if source.format == "csv":
            df = read_csv(self.spark, source.path, source.schema)
        elif source.format == "sav":
            df = read_sav(self.spark, source.path)
        else:
            reader = self.spark.read.format(source.format)
            df = (reader.schema(source.schema) if source.schema else reader).load(source.path)
        quoted = lambda x: "`" + x.replace("`", "``") + "`"
        kinds = dict(df.dtypes)
        made = {x: F.col(quoted(x)).cast("string").try_cast("timestamp_ntz") for x in source.times if kinds.get(x) == "string"}
        made |= {x: F.col(quoted(x)).cast("timestamp_ntz") for x in source.times if kinds.get(x) in ("date", "timestamp")}
        made |= {x: F.col(quoted(x)).try_cast("double") for x in source.numbers if x in kinds}
        df = df.select(*[made.get(x, F.col(quoted(x))).alias(source.renamed.get(x, x), metadata=df.schema[x].metadata | ({"comment": source.labels[x]} if x in source.labels else {})) for x in df.columns])
        if use_cache:
            self._held[name] = df.cache() if self.persist else df
        return df

    def load_all(self) -> dict[str, DataFrame]:
        """All tables that have a path."""
        return {n: self.load(n) for n, s in self.sources.items() if s.path}

    def metadata(self, name: str) -> dict:
        """name, rows, columns, their types and labels, and the megabytes of the files."""
        df = self.load(name)
        source = self.sources[name]
        reader = self.spark.read.format("binaryFile" if source.format == "sav" else source.format)
        files = reader.load(source.path).select("_metadata.file_path", "_metadata.file_size").distinct()
        size = files.agg(F.sum("file_size")).first()[0] or 0
        labels = {f.name: f.metadata["comment"] for f in df.schema.fields if "comment" in f.metadata}
        return {"name": name, "n_rows": df.count(), "n_columns": len(df.columns), "types": dict(df.dtypes), "labels": labels, "size_mb": size / 1e6}

    def summary(self) -> DataFrame:
        """(dataset, n_rows, n_columns, error): one row for each table; one that can't be read has its error's text."""
        rows = []
        for name in self.sources:
            try:
                df = self.load(name)
                rows.append((name, df.count(), len(df.columns), None))
            except (PySparkException, ValueError) as e:
                rows.append((name, None, None, str(e).splitlines()[0]))
        return self.spark.createDataFrame(rows, "dataset string, n_rows long, n_columns int, error string")

    def clear(self) -> None:
        """Forget all tables, also what Spark keeps of them."""
        for df in self._held.values() if self.persist else ():
            df.unpersist()
        self._held.clear()


def bind_events(events: DataFrame, anchor: str) -> DataFrame:
    """The event schema from an ``events`` table: value is the duration, props.k gives the rate interval; times count from the anchor."""
    hour = F.hour("ts")
    part = F.when(hour < 6, "night 00-05:59").when(hour < 12, "morning 6-11:59").when(hour < 18, "afternoon 12-17:59").otherwise("evening 18-23:59")
    rr = 200 + 18 * F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.col("ts").alias("start_ts"), F.col("value").alias("duration"),
        F.lit(anchor).cast("timestamp_ntz").alias("anchor_ts"), rr.alias("rr"), (60000 / rr).alias("rate"), part.alias("day_part"),
    )
