import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from monthlens.session import get_spark
    s = get_spark("local[4]", 4, app="monthlens-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="monthlens-test-ckpt-")})
    yield s
    s.stop()


SF0001 = "/root/testdata/sf0.001"
