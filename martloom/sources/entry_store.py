"""Daily entries kept as an append-only log, read as the newest per day."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import entry_rules, missing_days
from ..operators.stable import stable
from .sinks import upsert_latest
from .tables import lookup


class EntryStore:
    """load / get / missing_days / upsert over ``root``.

    Saving appends files and rewrites nothing, so concurrent readers always
    see whole saves; a later save of a day replaces the earlier one on read.
    The log is partitioned by month.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "business_date"):
        self.spark, self.root, self.key = spark, root, key

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load(self) -> DataFrame:
        log = self.spark.read.parquet(self.root)
        return upsert_latest(log, self.key, ["entered_at", "save_id"]).drop(
            "month", "entered_at", "save_id")

    def get(self, day) -> DataFrame:
        """The entry of one day; only its month is read."""
        log = self.spark.read.parquet(self.root).filter(
            F.col("month") == F.date_format(F.lit(day).cast("date"), "yyyyMM").cast("int"))
        return upsert_latest(lookup(log, self.key, day), self.key,
                             ["entered_at", "save_id"]).drop("month", "entered_at", "save_id")

    def missing_days(self, today, back: int = 14) -> DataFrame:
        return missing_days(self.load(), today, back, self.key)

    def upsert(self, entries: DataFrame) -> DataFrame:
        """Save one entry per day; returns (day, 'saved' | 'updated' |
        'blocked'). Blocked entries are not written. Two entries for a day in
        one save are refused: neither would be the later one."""
        twice = entries.groupBy(self.key).count().filter("count > 1").select(self.key).first()
        if twice is not None:
            raise ValueError(f"two entries for {twice[0]} in one save")
        checked = entry_rules(entries)
        state = checked.select(self.key, "is_blocked")
        if self._exists():
            # only the months being saved are read
            months = checked.select(F.date_format(self.key, "yyyyMM").cast("int").alias("month")).distinct()
            had = (self.spark.read.parquet(self.root).select(self.key, "month")
                   .join(months, "month", "left_semi").select(self.key).distinct())
            state = state.join(had.withColumn("_had", F.lit(True)), self.key, "left")
        else:
            state = state.withColumn("_had", F.lit(False))
        actions = stable(state.select(
            self.key, F.when(F.col("is_blocked"), "blocked").when(F.col("_had"), "updated")
            .otherwise("saved").alias("action")), "actions")
        (checked.filter(~F.col("is_blocked")).drop("is_blocked", "warnings")
         .withColumn("entered_at", F.current_timestamp()).withColumn("save_id", F.uuid())
         .withColumn("month", F.date_format(self.key, "yyyyMM").cast("int"))
         .write.mode("append").partitionBy("month").parquet(self.root))
        return actions
