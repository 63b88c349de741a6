import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session
    s = get_session("local[*]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck001():
    from quarry.plans.oracle import duck_connection
    return duck_connection(SF001)
