import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to rows of arguments and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}")
        names = df.columns[1:]
        return [r["out"] for r in df.select("i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("i").collect()]

    return run
