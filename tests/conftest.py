import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session("8", partitions=4, name="tidemark-tests")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.catalog import Tables

    return Tables(spark, SMALL)
