import os

import pytest

from quietlog.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "quietlog-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture
def column(spark):
    """Evaluate a Column function on a list of texts."""

    def run(function, values, name="log"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
        rows = df.select("i", function().alias("out")).orderBy("i").collect()
        return [r["out"] for r in rows]

    return run
