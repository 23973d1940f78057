from __future__ import annotations

import pytest

from placelens.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session(4, partitions=4, memory="6g", settings=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every dim counts as too large to broadcast, and a fifth of the rows makes a key hot."""
    from placelens.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
