import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendlens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("spendlens-tests", "4")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A fresh scratch folder per test."""
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="session")
def small():
    return SMALL
