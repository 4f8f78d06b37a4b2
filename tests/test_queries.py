"""Every query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

from sunledger.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = lambda t: sorted(tuple(str(r[c]) for c in columns) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
