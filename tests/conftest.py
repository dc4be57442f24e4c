import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfrank.session import build_session, ship_package, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(tune(session))
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of an expression over rows of text columns a, b, c."""

    def run(expression, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        width = max(len(r) for r in rows)
        schema = ", ".join(f"{n} string" for n in "abc"[:width]) + ", i int"
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
        return [r[0] for r in df.select(expression.alias("v"), "i").orderBy("i").drop("i").collect()]

    return run
