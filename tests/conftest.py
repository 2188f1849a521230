import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from corvane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8")
    yield s
    s.stop()
