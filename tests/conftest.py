import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_panel(spark):
    """The smallest weekly panel with some missing values and ties, kept in memory."""
    from pyspark.sql import functions as F

    from panelwright.sources.panel import weekly_panel

    df = weekly_panel(spark, SF).df
    df = df.withColumn("x", F.when(F.pmod(F.xxhash64("entity", "date"), F.lit(7)) != 0, F.round(F.col("close") / 400)))
    df = df.withColumn("industry", F.when(F.pmod(F.xxhash64("date", "entity"), F.lit(9)) != 0, F.col("industry")))
    df = df.withColumn("market_cap", F.when(F.pmod(F.xxhash64("entity", "date"), F.lit(11)) != 0, F.col("market_cap") - 5e6))
    return df.cache()
