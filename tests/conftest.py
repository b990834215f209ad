import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="4g", name="tablewright-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
