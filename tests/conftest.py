import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=2, memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def day():
    return lambda n, month=1, year=2026: dt.date(year, month, n)
