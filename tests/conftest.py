import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from routeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("routeloom-tests", cpus=8)
    yield session
    session.stop()


def pytest_collection_modifyitems(items):
    """Tests that start a Spark of their own run first, before the shared session holds its memory."""
    first = [i for i in items if "test_another_folder" in i.nodeid]
    items[:] = first + [i for i in items if i not in first]
