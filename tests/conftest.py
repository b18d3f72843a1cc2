import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from prodtext.session import get_spark
    s = get_spark("prodtext-tests", "*", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="prodtext-test-ckpt-", dir="/tmp")
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE
