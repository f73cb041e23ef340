import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
DATA = os.environ.get("ANNOTARA_DATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from annotara.session import get_session

    s = get_session("tests", cores="4", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA
