import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowkeeper.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "rowkeeper-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def few_hot_rows(spark):
    """Treat keys with more than 40 rows as hot, so that small tables take the sliced path."""
    spark.conf.set("spark.rowkeeper.hotRows", "40")
    yield 40
    spark.conf.unset("spark.rowkeeper.hotRows")
