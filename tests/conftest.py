import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from tallyforge.harness.fixtures import Fixtures  # noqa: E402
from tallyforge.session import build_session  # noqa: E402

from helpers import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", 4, {"spark.driver.memory": "4g", "spark.sql.streaming.stateStore.maintenanceInterval": "1h"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data(spark):
    return Fixtures(spark, SF)
