"""Every query against its SQL over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check_oracles import TABLES, kind, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    names, rows = rows_of(got)
    if name not in ORACLES:
        assert rows
        return
    want = con.execute(ORACLES[name]).to_arrow_table()
    want_names, want_rows = rows_of(want)
    assert names == want_names
    assert [kind(got.schema.field(n).type) for n in names] == [kind(want.schema.field(n).type) for n in names]
    assert rows == want_rows
