import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from threadwatch.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="threadwatch-tests")
    yield s
    s.stop()
