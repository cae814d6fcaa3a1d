import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import local_session

    session = local_session("tests", cpus="4", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
