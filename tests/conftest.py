import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from verify import session

    s = session(4)
    env = s.sparkContext.environment
    env["PYTHONPATH"] = str(ROOT)
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
