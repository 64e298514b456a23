import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lapsekit.session import local_session

    shared = {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = local_session("tests", cores=8, **shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
