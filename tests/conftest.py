import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bazaarflow.session import local_session

    session = local_session("*")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a column expression on one row."""
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
