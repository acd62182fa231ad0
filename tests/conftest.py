import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from lodestrand.session import session
    from lodestrand.shipping import ship

    s = session("local[4]", 4, **{"spark.driver.memory": "4g"})
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
