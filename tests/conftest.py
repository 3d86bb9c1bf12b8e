from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docquarry.session import local_session  # noqa: E402


# column expressions in test modules need a session when they are collected
SESSION = local_session(8, "tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column expression over one row of strings."""

    def run(expr, **columns):
        schema = ", ".join(f"{c} string" for c in columns) or "x string"
        row = spark.createDataFrame([tuple(columns.values()) or ("",)], schema)
        return row.select(expr.alias("v")).first()["v"]

    return run
