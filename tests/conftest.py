import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest


@pytest.fixture(scope="session")
def spark():
    from corymb.session import session

    s = session("local[4]", 4, "2g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
