from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sightline.session import local_session

    session = local_session("8", "sightline-tests", 4)
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over rows given as tuples."""
    def values(rows, schema, expression):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, " + schema)
        return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return values
