import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
#: Queries are held against their SQL at the size where ties and rare cases show.
SF_SQL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.master": "local[4]", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def sf():
    return SF
