import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from depotlens.session import build_session
    # tests have no cluster-provided checkpoint folder: use a scratch one
    ckpt = tempfile.mkdtemp(prefix="depotlens-test-ckpt-")
    s = build_session("local[4]", 4, app_name="depotlens-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from depotlens.sources.fixtures import fixture_tables
    return fixture_tables(spark, SF_SMALL)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="depotlens-t-")
