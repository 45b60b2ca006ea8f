"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from circdesk.plans.oracle import ORACLE
from circdesk.plans.registry import QUERIES
from tests.conftest import SMALL
from tools.check_oracle import duck, sorted_rows


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con: duckdb.DuckDBPyConnection, name):
    df = QUERIES[name](spark, SMALL)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted_rows(names, found.fetchall())
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == want
