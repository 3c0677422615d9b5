import pytest

from foliolake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", shuffle_partitions=4)
    yield session
    session.stop()
