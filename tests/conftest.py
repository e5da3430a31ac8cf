from __future__ import annotations

import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(4, "tests", shuffle=4, memory="3g")
    yield session
    session.stop()
