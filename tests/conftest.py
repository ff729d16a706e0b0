import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.01"
SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from storelens.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="storelens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from storelens.sources.tables import load_tables
    return load_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    from storelens.oracle.check import duck_connection
    return duck_connection(SF_DIR)
