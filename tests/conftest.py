import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from redactflow.session import local_session

    s = local_session("*", shuffle_partitions=8, app="redactflow-tests", driver_memory="4g")
    yield s


@pytest.fixture
def docs(spark):
    def make(*texts, start_id=0):
        return spark.createDataFrame([(start_id + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return make
