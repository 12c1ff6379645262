import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def engine(spark, tmp_path):
    from tidewater.session import Engine

    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture
def shop(engine):
    engine.sql("CREATE TABLE growers (id INT PRIMARY KEY, name TEXT NOT NULL, age INT)")
    engine.sql("INSERT INTO growers VALUES (1, 'Nadia', 38), (2, 'Piet', 16)")
    engine.sql("CREATE TABLE crates (id INT PRIMARY KEY, grower INT, kilos FLOAT)")
    engine.sql("INSERT INTO crates VALUES (31, 1, 8.0), (32, 1, 3.5), (33, 2, 21.0)")
    return engine
