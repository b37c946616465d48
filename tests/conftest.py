import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from cloudmason.session import local_session

    s = local_session(8, shuffle_partitions=8, app="tests", memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    return s
