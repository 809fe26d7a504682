import os

import pytest

from shelfspark.session import local_session

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return TABLES
