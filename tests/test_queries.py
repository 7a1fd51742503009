"""Every registered query against its SQL counterpart, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from gritline.plans.queries import QUERIES as OWN  # noqa: E402
from tools.check import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(OWN) <= set(QUERIES) and set(OWN) <= set(ORACLE)


@pytest.mark.parametrize("name", list(OWN))
def test_query(spark, duck, name):
    got_types, got = canonical(QUERIES[name](spark, SF).toArrow())
    want_types, want = canonical(duck.sql(ORACLE[name]).to_arrow_table())
    assert got_types == want_types
    assert len(got) == len(want) > 0
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 40
