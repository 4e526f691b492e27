"""One local session for all tests."""

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from offerlens.session import local_session

    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = local_session(8, "tests", **{"spark__checkpoint__dir": f"{where}/shared", "spark__sql__warehouse__dir": f"{where}/warehouse", "spark__sql__shuffle__partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
