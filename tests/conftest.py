import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodgelens.session import get_session
    s = get_session("local[4]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lodgelens-test-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
