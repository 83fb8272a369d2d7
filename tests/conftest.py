import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from dhvani.session import get_spark
    s = get_spark("local[4]", "dhvani-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="dhvani-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def duck01():
    from harness import duck
    return duck(SF01)
