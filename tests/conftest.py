import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from windloom import session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", 4, **{"spark.driver.memory": "4g"})
    session.importable(s)
    return s


@pytest.fixture(scope="session")
def data():
    return DATA
