import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    own = session("local[4]", 4)
    own.sparkContext.setLogLevel("ERROR")
    return own
