import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from ledgerweave.session import local_session, shared_folder

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    session.stop()
