import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewatch.session import local_session, ship

    session = local_session(
        4, "tests", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__shuffle__partitions="4"
    )
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)
