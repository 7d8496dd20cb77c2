import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from yieldlens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="yieldlens-tests")
    yield s
    s.stop()


@pytest.fixture()
def facts_df(spark):
    """Build a log_data frame from tuples (id, process, model, line, station,
    status, failed_testcode, track_id, date, time, timestamp)."""
    from yieldlens import schemas as K

    def make(rows):
        return spark.createDataFrame(rows, K.LOG_DATA)
    return make
