import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from courtline.session import build_session
    s = build_session("local[4]", app="courtline-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g", "spark.sql.execution.pyarrow.udf.enabled": "true"})
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
