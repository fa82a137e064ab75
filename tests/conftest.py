import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A frame from lists; NaN and None are missing."""
    from plumbline.frame import ResponseFrame

    return lambda rows, **k: ResponseFrame.from_rows(spark, rows, **k)


@pytest.fixture(scope="session")
def values():
    """The scores of a column, in order."""
    return lambda f, c: [r[0] for r in f.df.select(c.alias("s"), "ord").orderBy("ord").select("s").collect()]
