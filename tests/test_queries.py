"""Each registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest
from tidewheel import queries as Q
from tidewheel import studies
from tidewheel.plans import study_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if x is None or x != x else f"{x:.5g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


QUERIES, SQL = Q.queries() | studies.queries(), Q.oracle_sql() | study_sql.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_id_overlap_has_every_document(spark):
    ids = lambda table, column: set(pd.read_parquet(f"{FOLDER}/{table}.parquet", columns=[column])[column])
    a, b, c = ids("documents", "doc_id"), ids("labels", "doc_id"), ids("events", "user_id")
    got = Q.queries()["id_overlap"](spark, FOLDER).first().asDict()
    assert (got["n_documents"], got["n_labels"], got["n_events"]) == (len(a), len(b), len(c))
    assert (got["n_documents_and_labels"], got["n_documents_and_events"], got["n_labels_and_events"]) == (len(a & b), len(a & c), len(b & c))
    assert (got["n_only_documents"], got["n_all"], got["n_any"]) == (len(a - b - c), len(a & b & c), len(a | b | c))
