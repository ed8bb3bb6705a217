import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.session import build_session, use_scratch  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(app="tillroll-tests", master="local[*]", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tillroll-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    use_scratch(s, tempfile.mkdtemp(prefix="tillroll-ckpt-"))
    yield s
    s.stop()
