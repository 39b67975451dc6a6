import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from softseek.session import local_session, release_scratch  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "softseek-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_scratch(session)


@pytest.fixture(scope="session")
def sf():
    return SF
