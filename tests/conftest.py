import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tidemark-tests-"), spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tidemark-warehouse-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
