import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mailsift.session import build_session
    session = build_session("tests", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA
