import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docaudit.shared import clean_up, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder.master("local[4]"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clean_up(session)
    session.stop()


@pytest.fixture
def each(spark):
    """Evaluate a column expression on a list of values."""

    def run(values, expression, schema="x string"):
        rows = spark.createDataFrame(
            [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)],
            f"i int, {schema}",
        )
        return [r[0] for r in rows.orderBy("i").select(expression.alias("y"), "i").orderBy("i").select("y").collect()]

    return run
