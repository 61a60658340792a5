"""Daily-entry stream: validate, log, keep the newest entry per day."""

from pyspark.sql import DataFrame, functions as F

from ..operators.quality import entry_rules
from ..sources.sinks import upsert_latest


def stream_entries(src: DataFrame, sink: str, checkpoint: str, key: str = "business_date",
                   order_by=("entered_at", "seq"), trigger=None):
    """Start the stream ``src`` -> ``sink``.

    Each micro-batch overwrites its own folder of an append-only log (so a
    replayed batch changes nothing) and then rebuilds, from the log, only the
    months it touched in the current table. Blocked entries are dropped.
    Both tables are partitioned by month.
    """
    def save(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        valid = (entry_rules(batch).filter(~F.col("is_blocked")).drop("is_blocked", "warnings")
                 .withColumn("month", F.date_format(key, "yyyyMM")))
        latest = upsert_latest(valid, key, order_by)
        path = f"{sink}/log/batch={batch_id}"
        latest.write.mode("overwrite").partitionBy("month").parquet(path)
        schema = latest.schema
        touched = spark.read.schema(schema).parquet(path).select("month").distinct()
        log = (spark.read.schema(schema).option("basePath", f"{sink}/log")
               .parquet(f"{sink}/log"))
        months = log.select(*schema.fieldNames()).join(touched, "month", "left_semi")
        (upsert_latest(months, key, order_by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("month")
         .parquet(f"{sink}/current"))

    return (src.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_entries(spark, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/current")
