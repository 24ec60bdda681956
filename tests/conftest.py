import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session(4, app="tabscope-tests", **conf)
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a function of one column over a list of values."""

    def run(function, values, kind="string"):
        df = spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, x {kind}")
        return [row[0] for row in df.orderBy("i").select(function(df["x"])).collect()]

    return run
