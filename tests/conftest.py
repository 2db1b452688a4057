import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = os.environ.get("SALESCOPE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from salescope.plans.session import build_session

    scratch = tempfile.mkdtemp(prefix="salescope-test-")
    s = build_session(
        master="local[4]",
        shuffle_partitions=8,
        app_name="salescope-tests",
        checkpoint_dir=os.path.join(scratch, "checkpoints"),
        driver_memory="4g",
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="salescope-scratch-")
