import pytest

from tarnlight.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
