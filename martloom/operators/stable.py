"""Cut lineage through shared storage."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_written = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse,
    which driver and executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or os.path.join(
        spark.conf.get("spark.sql.warehouse.dir"), "martloom-scratch")


def _at(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there is deleted by
    :func:`release`, or when the application ends."""
    name = os.path.join(shared_dir(spark), "martloom", f"{what}-{uuid.uuid4().hex}")
    _written.append(name)
    return name


def stable(df: DataFrame, what: str = "frame") -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    Used where one result is read several times and must be the same each
    time (partition offsets, iterations). Lost executors re-read files; the
    stored sizes let the optimizer choose joins from facts.
    """
    name = scratch_path(df.sparkSession, what)
    df.write.parquet(name)
    path, fs = _at(df.sparkSession, name)
    fs.deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(name)


def release(spark: SparkSession) -> int:
    """Delete what was stored in this session, once no frame built on it is
    needed any more. Returns how many tables were dropped."""
    dropped = 0
    while _written:
        path, fs = _at(spark, _written.pop())
        dropped += bool(fs.delete(path, True))
    return dropped
