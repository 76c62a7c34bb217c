import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loamworks.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    gateway = s.sparkContext._gateway
    s.stop()
    # Else the thread that served foreachBatch keeps the process alive.
    gateway.shutdown()


@pytest.fixture(scope="session")
def data():
    from tests.oracle import DATA

    return DATA
