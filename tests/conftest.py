from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marketloom.session import session

    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}
    s = session("local[4]", 4, **conf)
    s.sparkContext.setLogLevel("ERROR")
    return s
