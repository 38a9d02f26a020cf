import tempfile

import pytest

from checks.compare import session
from headwise.session import configure


@pytest.fixture(scope="session")
def spark():
    session_ = configure(session("local[4]"))
    session_.conf.set("spark.sql.shuffle.partitions", "4")
    session_.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield session_
    session_.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="run-")
