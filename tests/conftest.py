import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build_session
    s = build_session("local[*]", 8, "quarry-tests")
    # tests own their checkpoint folder (a cluster would name a shared one)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="quarry-test-")


SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
