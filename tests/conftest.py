"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cadence.session import session

    s = session(4, "tests", "4g", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
