import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sedimenta.session import local_session, ship

    s = local_session("4", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
