"""Every query of this subpackage that SQL can express, against DuckDB."""

import pytest

from circdesk.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from tools.check_oracle import duck, sorted_rows


@pytest.mark.parametrize("name", list(ORACLE))
@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_matches_sql(spark, name, sf_dir):
    found = duck(sf_dir).execute(ORACLE[name])
    names = [d[0] for d in found.description]
    want = sorted_rows(names, found.fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert want
