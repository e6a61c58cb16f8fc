import os
import sys
import time

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def drain(query, rows, seconds=100):
    """Let a stream take this many rows, and stop it: one whose state has a clock goes on without data and never ends by itself."""
    until = time.time() + seconds
    try:
        while time.time() < until and query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < rows:
            time.sleep(0.3)
        assert query.exception() is None and sum(p["numInputRows"] for p in query.recentProgress) == rows
    finally:
        query.stop()
