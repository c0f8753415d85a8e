"""One small session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false --conf spark.ui.enabled=false --driver-memory 6g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from scholion.session import build_session

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
import sys, pathlib; sys.path.insert(0, str(pathlib.Path(__file__).parent))
