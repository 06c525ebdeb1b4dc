import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from palisade.session import ensure_checkpoint_dir, local_session

    s = local_session(4, "tests")
    ensure_checkpoint_dir(s)
    return s
