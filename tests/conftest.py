import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recordloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.log.level": "ERROR",
           "spark.ui.showConsoleProgress": "false"},
    )
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column over single values."""
    def run(cases, column, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], f"i int, v {kind}")
        return [row.out for row in rows.select("i", column.alias("out")).orderBy("i").collect()]

    return run
