"""Every query of the catalogue against DuckDB, and once more on another layout."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    return v if isinstance(v, str) else round(float(v), 5)


def rows(got, columns):
    return sorted((tuple(norm(r[c]) for c in columns) for r in got), key=repr)


def spark_rows(df: DataFrame, columns):
    return rows((r.asDict() for r in df.collect()), columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    assert spark_rows(df, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["q_reason_index", "q_greedy_dedup", "q_len_positions", "q_centroids"])
def test_layout_does_not_matter(spark, monkeypatch, name):
    import importlib

    module = importlib.import_module(QUERIES[name].__module__)
    columns = sorted((first := QUERIES[name](spark, DATA)).columns)
    want = spark_rows(first, columns)
    plain = module.table
    monkeypatch.setattr(module, "table", lambda s, d, t: plain(s, d, t).repartition(7))
    assert spark_rows(QUERIES[name](spark, DATA), columns) == want


def test_batches_of_more_than_six_digits(spark, duck, monkeypatch):
    """The last digits of a seventh place are cut as in SQL: ranks are moved up to where they have one."""
    from tessera.plans import texts

    plain = texts._index
    monkeypatch.setattr(texts, "_index", lambda s, d: plain(s, d).withColumn("idx", F.col("idx") + 19_999_930))
    for name in ("q_batches", "q_retry_batches"):
        rel = duck.execute(SQL[name].replace("AS idx FROM c", "+ 19999930 AS idx FROM c"))
        columns = [c[0] for c in rel.description]
        want = [dict(zip(columns, r, strict=True)) for r in rel.fetchall()]
        got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
        assert rows(got, columns) == rows(want, columns) and any(r["batch"] == "batch_100000" for r in got)
