import pytest

from foliospark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
