import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from webdiag.session import get_spark
    shared = str(tmp_path_factory.mktemp("shared"))
    s = get_spark("local[2]", app="webdiag-tests", shuffle_partitions=4, extra={"spark.checkpoint.dir": shared})
    yield s
    s.stop()
