from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from postlens import schemas  # noqa: E402
from postlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows given as dicts, shaped by a DDL schema; absent fields are NULL."""

    def build(ddl: str, *rows: dict):
        schema = schemas.struct(ddl)
        known = set(schema.fieldNames())
        assert all(set(r) <= known for r in rows), [set(r) - known for r in rows]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def column(spark):
    """Values of one expression over rows of a small frame."""

    def values(rows, ddl: str, expression):
        df = spark.createDataFrame(rows, schemas.struct(ddl))
        return [r[0] for r in df.select(expression.alias("v")).collect()]

    return values
