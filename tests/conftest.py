import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sightline.session import ensure_conf, local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    ensure_conf(session)
    ship_package(session)
    yield session
    session.stop()
