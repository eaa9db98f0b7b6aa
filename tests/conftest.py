import pytest

from quillfin.session import checkpoint_dir, local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    checkpoint_dir(session)
    ship_package(session)
    yield session
