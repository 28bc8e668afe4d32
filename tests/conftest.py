import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from nichelab.session import build_session, ensure_checkpoint_dir

    s = build_session("local[4]", app_name="nichelab-tests", shuffle_partitions=8)
    # tests run without a cluster: a private checkpoint folder only when none is configured
    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="nichelab-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="nichelab-test-")
