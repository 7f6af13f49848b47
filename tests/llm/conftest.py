import os
import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-tests-"))
    yield


SMALL = "/root/testdata/sf0.001"
assert os.path.isdir(SMALL)
