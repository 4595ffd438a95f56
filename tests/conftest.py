import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flightops.session import build_session, scratch_root

    s = build_session("local[*]", app_name="flightops-tests", shuffle_partitions=8)
    scratch_root(s)  # uses spark.checkpoint.dir, or sets a local one when unset
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_sf():
    return SMALL_SF
