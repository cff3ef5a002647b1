import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomspan.session import local_session

    session = local_session("tests", cpus=4, partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()
