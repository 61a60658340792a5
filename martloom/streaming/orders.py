"""Order streams: daily KPIs and duplicate suppression, exact for any cut of the
input into batches and any delay.

Both keep a log with one folder per micro-batch, which a replayed batch writes
over; there is no watermark and no state, so nothing is ever too late.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Sums per day, by the column they need; those of absent columns are left out.
DAY_SUMS = {
    "items_sold": ("item_qty", F.sum), "gross_revenue": ("gross_amount", F.sum),
    "discount_total": ("discount_amount", F.sum), "delivery_fee_total": ("delivery_fee", F.sum),
    "commission_total": ("commission_amount", F.sum), "net_revenue": ("net_revenue", F.sum),
    "food_cost": ("food_cost", F.sum),
    "delivery_minutes": ("actual_min", lambda c: F.sum(F.when(F.col("is_delivery"), F.col(c)))),
    "timed_orders": ("actual_min", lambda c: F.count(F.when(F.col("is_delivery"), F.col(c)))),
    "late_orders": ("is_late", lambda c: F.count_if(F.col("is_delivery") & F.col(c)))}


def order_day_sums(orders: DataFrame, ts: str = "order_ts") -> DataFrame:
    """The order-side KPIs of each day, all of them sums that can be added up."""
    trip = F.col("is_delivery")
    return orders.groupBy(F.to_date(ts).alias("full_date")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(trip).alias("delivery_orders"),
        F.count_if(~trip).alias("pickup_orders"), F.count_if("is_cancelled").alias("cancelled_orders"),
        *[f(c).alias(out) for out, (c, f) in DAY_SUMS.items() if c in orders.columns])


def _logged(frame: DataFrame, save, checkpoint: str, trigger):
    return (frame.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_kpi(orders: DataFrame, sink: str, checkpoint: str, ts: str = "order_ts", trigger=None):
    """Write each micro-batch's sums per day to its own folder of the log."""
    def save(batch: DataFrame, batch_id: int):
        order_day_sums(batch, ts).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _logged(orders, save, checkpoint, trigger)


def stream_kpi_result(spark: SparkSession, sink: str) -> DataFrame:
    """The sums of all batches: one row per day."""
    log = spark.read.parquet(sink).drop("batch")
    return log.groupBy("full_date").agg(*[F.sum(c).cast(t).alias(c) for c, t in log.dtypes if c != "full_date"])


def stream_orders(orders: DataFrame, sink: str, checkpoint: str, trigger=None):
    """Write each micro-batch to its own folder of the log."""
    def save(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _logged(orders, save, checkpoint, trigger)


def distinct_orders(spark: SparkSession, sink: str, key: str = "order_key") -> DataFrame:
    """One copy of each order of the log: copies are alike, whenever they came."""
    return spark.read.parquet(sink).drop("batch").dropDuplicates([key])
