import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from segmint.session import get_session
    scratch = tempfile.mkdtemp(prefix="segmint-test-")
    s = get_session("local[4]", 4, app_name="segmint-tests",
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                           "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
                           "spark.local.dir": scratch,
                           "spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="segmint-t-")
