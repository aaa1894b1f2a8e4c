import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigil.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4)
    yield s


@pytest.fixture
def users(spark):
    # two missing addresses, one missing age, two ages out of range, one rare status
    rows = [(1, "ines@post.example", 41, "open"), (2, "jaro@post.example", 33, "open"),
            (3, None, 58, "open"), (4, "kofi@post.example", -3, "closed"),
            (5, "lena@post.example", 140, "lost"), (6, "mio@post.example", None, "open"),
            (7, None, 22, "open"), (8, "nour@post.example", 64, "closed")]
    return spark.createDataFrame(rows, "id int, email string, age int, status string")


METRIC = [20.0, 21.5, 19.0, 20.5, 90.0, 19.5, 21.0, 20.5]


@pytest.fixture
def metrics(spark):
    rows = [(f"2025-03-{i + 11}", v) for i, v in enumerate(METRIC)]
    return spark.createDataFrame(rows, "dt string, val double")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
