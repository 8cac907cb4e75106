from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from querytide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8)
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()


@pytest.fixture
def workdir(tmp_path):
    return str(tmp_path)


@pytest.fixture(scope="session")
def day_log(spark):
    import fixture_day

    log = fixture_day.log(spark).cache()
    log.count()
    return log
