"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from registry.oracles import ORACLES
from registry.queries import QUERIES


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, str):
        return value
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    return repr(float(value) + 0.0)


def rows(frame):
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in ordered.itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"reduce_dims", "fcm_fit_seeded", "sweep_k"}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLES:
        want = tables.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_long_logs_are_streamed_from_several_files(spark, tables, sf, monkeypatch, tmp_path):
    """A micro-batch of a long log is written by several tasks; the decisions are the same."""
    from registry import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 400)
    stream = queries._in_order(spark, spark.range(1000).withColumnRenamed("id", "seq"), str(tmp_path))
    assert len(list((tmp_path / "log").glob("part-*.parquet"))) == 12 and stream.isStreaming
    want = tables.sql(ORACLES["cache_replay_stream"]).df()
    assert rows(queries.cache_replay_stream(spark, sf).toPandas()) == rows(want)
