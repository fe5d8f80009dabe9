import pytest

from gneiss.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(cpus=3, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
