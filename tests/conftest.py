import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from rackpulse.session import build_session, checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", "rackpulse-tests", shuffle_partitions=8)
    # tests run without a cluster-provided spark.checkpoint.dir: install a scratch one
    checkpoint_dir(s, tempfile.mkdtemp(prefix="rackpulse-test-ckpt-"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="rackpulse-test-")
