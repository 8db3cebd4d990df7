"""Every registered query against its SQL in DuckDB, row by row."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tickloom.plans.catalogue import QUERIES

NAMES = sorted(set(queries()) & set(oracle_sql()))


def test_every_catalogue_query_has_sql():
    assert set(QUERIES) <= set(NAMES)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    cursor = con.execute(oracle_sql()[name])
    expected = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    df = queries()[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1]) > 0
    assert got[1] == expected[1]


def test_entry(spark):
    assert entry(spark).count() > 0
