import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from warmstart.session import get_spark

    s = get_spark("local[*]", 8, app_name="warmstart-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rat(spark):
    from warmstart.sources import fixtures as fx

    return fx.ratings(spark, SF).cache()
