import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tests.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data(spark):
    from registry.base import Data

    return Data(spark, "/root/testdata/sf0.001")
