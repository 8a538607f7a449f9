from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from graphaxis.session import local_session

    session = local_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def steps_are_freed():
    """What a test's plans stored goes when it ends."""
    yield
    from graphaxis.plans.store import release

    release()
