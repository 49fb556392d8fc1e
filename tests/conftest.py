import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from serpframe.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, app="serpframe-tests")
    yield s
    s.stop()


def one(spark, expr, value, ddl="x string"):
    """Evaluate a column function on one literal value."""
    from pyspark.sql import functions as F  # noqa: F401
    df = spark.createDataFrame([(value,)], ddl)
    return df.select(expr(df.columns[0]).alias("r")).collect()[0]["r"]
