import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tripflow.session import build_session

    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        # Plans are compared as text and must not be cut.
        "spark.sql.maxMetadataStringLength": "100000",
        "spark.sql.debug.maxToStringFields": "1000",
    }
    session = build_session("tests", master="local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
