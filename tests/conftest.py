import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from karyon.session import local_session

    s = local_session(cores=4, partitions=4, folder=f"file://{tmp_path_factory.mktemp('shared')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def ws(spark):
    from karyon.plans.workspace import Workspace

    w = Workspace(spark, "test")
    yield w
    w.close()
