import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatterloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests")


@pytest.fixture(scope="session")
def words_df(spark):
    return lambda words: spark.createDataFrame([(w,) for w in words], "word string")


@pytest.fixture(scope="session")
def pairs_df(spark):
    return lambda pairs: spark.createDataFrame(list(pairs), "key string, value string")
