import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tagloom.session import session

    s = session("local[4]", shuffle_partitions=4, app="tagloom-tests", memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
