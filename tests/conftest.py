import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hostshelf.session import build_session, checkpoint_dir

    s = build_session("local[*]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="hostshelf-shared-")})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="hostshelf-test-")
