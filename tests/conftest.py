import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from riskgrid.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app_name="riskgrid-tests")
    yield s
    s.stop()
