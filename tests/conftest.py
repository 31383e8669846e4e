import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="tests")
    prepare(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
