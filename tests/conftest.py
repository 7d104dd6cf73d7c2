import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stripweave.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def chunked(spark):
    """Treat every group of more than two rows as too large for one task, in chunks of three."""
    spark.conf.set("spark.stripweave.groupRows", "2")
    spark.conf.set("spark.stripweave.chunkRows", "3")
    yield
    spark.conf.unset("spark.stripweave.groupRows")
    spark.conf.unset("spark.stripweave.chunkRows")
