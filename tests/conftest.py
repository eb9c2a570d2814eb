import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from molsift.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(master="local[4]", shuffle_partitions=4)
    yield session
    session.stop()
