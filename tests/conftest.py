import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyframe.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local("4", "tests", partitions=4)
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL
