import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from feedlake.session import local_session
    s = local_session(cores=2, shuffle_partitions=4, app="feedlake-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


def payloads_df(spark, bodies, kind="feed"):
    rows = [(f"p{i}", f"http://x/{i}", kind, None, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload_id string, url string, kind string, fetched_at timestamp, body string")
