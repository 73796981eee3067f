"""Every registered query runs; where SQL expresses it, DuckDB agrees."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA

import __spark_entry__ as entry

QUERIES = {k: v for k, v in entry.queries().items() if not k.startswith("op") and k != "pipeline"}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(rows, at):
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    names = sorted(df.columns)
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == names
        assert rows_of(got, [df.columns.index(c) for c in names]) == rows_of(rel.fetchall(), [rel.columns.index(c) for c in names])
    else:
        assert got


def test_shape_distance_to_the_last_bit(spark, tmp_path):
    """The sign of a zero, halves of the sixth decimal, nulls and what isn't a number."""
    r = np.random.default_rng(1)
    rows = [list(v) for v in r.normal(size=(6, 64))] + [[0.0] * 64, [1.0] * 64, [-1.0] * 64, [math.nan] + [1.0] * 63, [math.inf] + [1.0] * 63, [1e200] * 64, [1.0, None] * 32, [None] * 64, None, [], [1.0] * 20]
    rows += [[float(2 ** (i + j) * (j < 4)) for j in r.integers(0, 9, 64)] for i in range(20)]
    sql = SQL["shape_distance"]
    for i, first in enumerate((0, 3, 6, 9, 12, 15, len(rows))):
        path = tmp_path / str(i)
        path.mkdir()
        # the four first rows are what all are compared with; at last there are none
        at = list(range(len(rows))) if first == len(rows) else [(n - first) % len(rows) for n in range(len(rows))]
        pq.write_table(pa.table({"vec_id": pa.array([n + 4 * (first == len(rows)) for n in at]), "embedding": pa.array(rows, pa.list_(pa.float64())), "label": [0] * len(rows)}), path / "embeddings.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
        got = {x.id: repr(x.distances) for x in QUERIES["shape_distance"](spark, str(path)).collect()}
        assert got == {k: repr(v) for k, v in con.sql(sql).fetchall()}


@pytest.mark.parametrize("data", [DATA, entry.DATA])
def test_shape_distance_keeps_the_sign_of_zero(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = {k: repr(v) for k, v in con.sql(SQL["shape_distance"]).fetchall()}
    assert {x.id: repr(x.distances) for x in QUERIES["shape_distance"](spark, data).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert os.path.isdir(entry.DATA)


def test_sql_names_are_queries():
    assert set(SQL) <= set(entry.queries())


def zeros_among_events(spark, tmp_path, name):
    """(rows of a query, rows of its SQL) on events with zeros, and on nothing else."""
    events = pq.read_table(f"{DATA}/events.parquet")
    value = events.column("value").to_numpy()
    at = np.arange(len(value))
    events = events.set_column(events.schema.get_field_index("user_id"), "user_id", pa.array(at // 500))
    for case, v in {"some": np.where(at % 97 == 5, 0.0, value), "nodes": np.where(at // 100 % 3 == 1, 0.0, value), "all": value * 0, "same": value * 0 + 7}.items():
        path = tmp_path / case
        path.mkdir()
        pq.write_table(events.set_column(events.schema.get_field_index("value"), "value", pa.array(v)), path / "events.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
        df, rel = QUERIES[name](spark, str(path)), con.sql(SQL[name])
        names = sorted(df.columns)
        yield rows_of(df.collect(), [df.columns.index(c) for c in names]), rows_of(rel.fetchall(), [rel.columns.index(c) for c in names])


@pytest.mark.parametrize("name", ["vector_errors", "prf", "auc", "r2_mse_mae"])
def test_metrics_divide_by_zero_like_their_sql(spark, tmp_path, name):
    for got, want in zeros_among_events(spark, tmp_path, name):
        assert got == want


@pytest.mark.parametrize("name", ["quality_windows", "mean_errors", "budgeted_recode"])
def test_relative_errors_of_zeros_like_their_sql(spark, tmp_path, name):
    for got, want in zeros_among_events(spark, tmp_path, name):
        assert got == want
