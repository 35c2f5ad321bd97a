import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = os.environ.get("SOUK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from souk.session import get_session
    s = get_session(master="local[8]", shuffle_partitions=8, app="souk-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def T(spark, sf_dir):
    from souk.sources.fixtures import fixture_tables
    return fixture_tables(spark, sf_dir)
