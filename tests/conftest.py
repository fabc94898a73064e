import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="statuta-tests-")
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         # one driver runs all tests: it keeps no long record of finished work
         .config("spark.ui.retainedJobs", "100").config("spark.ui.retainedStages", "100")
         .config("spark.ui.retainedTasks", "1000").config("spark.sql.ui.retainedExecutions", "20")
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests only: no cluster folder is configured, so use a scratch one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    yield s


@pytest.fixture(autouse=True)
def no_cached_frames():
    """Frames that a test's queries keep do not stay in the one driver's memory."""
    yield
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    if s is not None:
        s.catalog.clearCache()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)


SF_SMALL = "/root/testdata/sf0.001"
