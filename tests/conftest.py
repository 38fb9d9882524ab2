import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodeweave.session import local_session

    return local_session("4", 4, "4g")


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA
