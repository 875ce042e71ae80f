import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from tripweave.session import clean_up, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tripweave-tests", "4g")
    yield session
    clean_up(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
