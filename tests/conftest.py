import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from circdesk.session import local_session

SMALL = "/root/testdata/sf0.001"
NOW = "2001-08-01 00:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scratch"))
    session = local_session("8", **{"spark.checkpoint.dir": folder, "spark.driver.memory": "4g"})
    yield session
    session.stop()


def day(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows(df, *columns):
    """Rows of the named columns as a sorted list of tuples, nulls first."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
