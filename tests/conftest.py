import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridsonde.session import local_session  # noqa: E402

LEVELS = (0, 5, 10, 20, 30, 50, 75, 100, 125, 150, 200, 300, 500, 700, 1000)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "gridsonde-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
