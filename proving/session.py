"""Local session for tests and benchmarks."""

import os

from pyspark.sql import SparkSession


def local_session(cpus=None, app="martloom"):
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             # call-site capture costs milliseconds per column expression
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
