"""Every registered query of the engine against DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from ridgeline.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _rows(columns, rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted([tuple(cell(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, DIR)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = oracle.execute(catalogue.oracle_sql()[name])
    assert got == _rows([c[0] for c in found.description], found.fetchall())
