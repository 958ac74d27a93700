"""One local session for all tests; shared folders and the warehouse lie in a fresh temporary folder."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.local.dir": f"{top}/local",
        "spark.sql.warehouse.dir": f"{top}/warehouse",
        "spark.checkpoint.dir": f"file://{top}/shared",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def matches_dir() -> str:
    """The smallest tables with several matches and seasons."""
    return f"{DATA}/sf0.01"
