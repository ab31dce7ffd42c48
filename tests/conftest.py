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
    from annualis.session import checkpoint_dir, local_session
    s = local_session(4, shuffle_partitions=4, app="annualis-tests")
    checkpoint_dir(s)  # sets a scratch checkpoint folder only because the test session has none
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="annualis-test-")
