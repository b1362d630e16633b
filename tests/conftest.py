import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def hot(spark):
    """Treat every group above 20 rows as hot and broadcast nothing."""
    spark.conf.set("spark.platelens.hotGroupRows", "20")
    spark.conf.set("spark.platelens.broadcastRows", "0")
    yield spark
    spark.conf.unset("spark.platelens.hotGroupRows")
    spark.conf.unset("spark.platelens.broadcastRows")
