"""A star schema derived from the generated tables by integer arithmetic that
another engine can repeat. These are proxies for testing, not claims about
the data."""

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom import fixed_values as V
from martloom.functions import date_key_of, date_of_key, daypart, is_late, money
from martloom.operators import etl
from martloom.operators.order import surrogate_keys
from martloom.operators.stable import stable
from martloom.plans import marts

# the events table covers January 2024; this shift lays it across the end of
# the order history
EVENT_SHIFT_DAYS = 8202
LINE_MONEY = "decimal(8,2)"


def literal_table(spark, columns: dict, types: dict) -> DataFrame:
    """A short constant table the optimizer knows the size of."""
    return spark.createDataFrame(pa.table({
        n: pa.array(v, types[n]) for n, v in columns.items()}))


def cents(c):
    return F.round(F.col(c).cast("decimal(18,4)"), 2).cast("decimal(18,2)")


class Star:
    """Lazy DataFrames; each property only describes a plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._raw = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        """A given table; the footer is read once per star."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    # ----------------------------------------------------------- dimensions
    @cached_property
    def bounds(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        return self.raw("orders").agg(F.min(day).alias("start"), F.max(day).alias("end"))

    @cached_property
    def plain_calendar(self) -> DataFrame:
        return etl.calendar_of(self.bounds)

    @cached_property
    def weather(self) -> DataFrame:
        u = F.unix_date("full_date")
        known = u % 29 != 0
        temp = (u * 13 % 25) + F.lit(0.5)
        return self.plain_calendar.select(
            "full_date",
            F.when(known, temp.cast("decimal(5,2)")).alias("temp_mean_c"),
            F.when(known, (temp + 6).cast("decimal(5,2)")).alias("temp_max_c"),
            F.when(known, (u * 31 % 17 * 60 / 100).cast("decimal(6,2)"))
            .alias("precipitation_mm"),
            (u * 7 % 40 + 5).cast("decimal(6,2)").alias("wind_max_kmh"))

    @cached_property
    def holidays(self) -> DataFrame:
        u = F.unix_date("full_date")
        return self.plain_calendar.filter(u % 30 == 0).select(
            F.col("full_date").alias("holiday_date"),
            F.concat(F.lit("Holiday "), (u % 7).cast("string")).alias("holiday_name"))

    @cached_property
    def spans(self) -> DataFrame:
        years = self.plain_calendar.select("year").distinct()
        summer = years.select(F.lit("summer").alias("name"),
                              F.make_date("year", F.lit(7), F.lit(9)).alias("start"),
                              F.make_date("year", F.lit(8), F.lit(22)).alias("end"))
        winter = years.select(F.lit("winter").alias("name"),
                              F.make_date("year", F.lit(12), F.lit(22)).alias("start"),
                              F.make_date(F.col("year") + 1, F.lit(1), F.lit(2)).alias("end"))
        return summer.unionByName(winter)

    @cached_property
    def calendar(self) -> DataFrame:
        return etl.with_weather(
            etl.with_holidays(self.plain_calendar, self.holidays, self.spans), self.weather)

    @cached_property
    def channels(self) -> DataFrame:
        keys, names, agg, rate = zip(*V.CHANNELS)
        return literal_table(
            self.spark, {"channel_key": keys, "channel_name": names,
                         "is_aggregator": agg, "commission_rate": rate},
            {"channel_key": pa.int64(), "channel_name": pa.string(),
             "is_aggregator": pa.bool_(), "commission_rate": pa.decimal128(5, 4)})

    @cached_property
    def zones(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        km = 1 + n * 7 % 10
        return self.raw("nation").select(
            (n + 1).alias("zone_key"), (n + 14467).cast("string").alias("plz"),
            F.col("n_name").alias("district_name"),
            km.cast("decimal(5,2)").alias("distance_km"),
            (4 + km * 2).cast("decimal(5,2)").alias("base_drive_min"),
            (km * 50 / 100).cast("decimal(5,2)").alias("delivery_fee"))

    @cached_property
    def items(self) -> DataFrame:
        price = cents("p_retailprice")
        sizes = F.when(F.col("p_size") % 4 == 1, "small").when(
            F.col("p_size") % 4 == 2, "normal").when(F.col("p_size") % 4 == 3, "large")
        return self.raw("part").select(
            F.col("p_partkey").alias("item_key"), F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category"), sizes.alias("size_name"),
            price.alias("unit_price"),
            money(F.round(price * F.lit("0.3").cast("decimal(2,1)"), 2)).alias("unit_cost"),
            (F.col("p_size") % 2 == 0).alias("is_vegetarian"))

    @cached_property
    def drivers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            (key + 1).alias("driver_key"), F.col("s_name").alias("driver_name"),
            F.make_date(F.lit(2024), F.lit(1), F.lit(15)).alias("hired_on"),
            F.when(key % 3 == 0, "Roller").when(key % 3 == 1, "Auto")
            .otherwise("Fahrrad").alias("vehicle"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("customer_code"),
            (F.col("c_nationkey").cast("long") + 1).alias("zone_key"),
            F.col("c_mktsegment").alias("signup_channel"))

    # ---------------------------------------------------------------- facts
    @cached_property
    def lines(self) -> DataFrame:
        """Order lines without a surrogate key. Line money keeps the declared
        decimal(8,2), which Spark sums as plain integers."""
        price = F.col("l_extendedprice").cast(LINE_MONEY)
        cost = F.round(price * F.lit("0.3").cast("decimal(2,1)"), 2)
        saved = F.round(price * F.col("l_discount").cast("decimal(3,2)"), 2)
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("item_key"),
            F.col("l_quantity").cast("long").alias("quantity"),
            price.alias("line_revenue"), cost.cast(LINE_MONEY).alias("line_cost"),
            saved.cast(LINE_MONEY).alias("line_discount"))

    @cached_property
    def order_lines(self) -> DataFrame:
        """Order lines with date and surrogate key; lines may repeat exactly."""
        dated = self.lines.join(
            self.raw("orders").select(F.col("o_orderkey").alias("order_key"),
                                      self._date_key().alias("date_key")), "order_key")
        order = ["order_key", "item_key", "quantity", "line_revenue", "line_cost",
                 "line_discount"]
        return surrogate_keys(dated, [*order, "date_key"], "order_item_key")

    @staticmethod
    def _date_key():
        return date_key_of(F.col("o_orderdate").cast("date"))

    @cached_property
    def order_heads(self) -> DataFrame:
        return self.as_order_heads(self.raw("orders"))

    def as_order_heads(self, raw: DataFrame, keep=()) -> DataFrame:
        """Order attributes that need no other table; also valid on a stream."""
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        channel = F.substring("o_orderpriority", 1, 1).cast("long")
        trip = channel != 5
        zone = F.when(trip, F.col("o_custkey") % 25 + 1)
        minutes = 660 + key * 7919 % 720
        return raw.select(
            key.alias("order_key"), self._date_key().alias("date_key"),
            F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minutes * 60)
            .alias("order_ts"),
            F.col("o_custkey").alias("customer_key"), channel.alias("channel_key"),
            zone.alias("zone_key"), F.when(trip, key % 6 + 1).alias("driver_key"),
            trip.alias("is_delivery"),
            F.when(trip, F.lit(45)).alias("promised_min"),
            F.when(trip, (15 + (key * 37 + zone * 11) % 50).cast("int")).alias("actual_min"),
            (key % 67 == 0).alias("is_cancelled"),
            F.when(key % 10 == 0, "2FOR1").alias("promo_code"), *keep)

    @cached_property
    def orders(self) -> DataFrame:
        heads = self.order_heads.withColumn("daypart", daypart("order_ts")).withColumn(
            "is_late", is_late("actual_min", "promised_min"))
        totals = etl.rollup_lines(self.lines)
        joined = heads.join(totals, "order_key", "left").withColumns({
            "gross_amount": money(F.coalesce("gross_amount", F.lit(0))),
            "food_cost": money(F.coalesce("food_cost", F.lit(0))),
            "discount_amount": money(F.coalesce("discount_amount", F.lit(0))),
            "item_qty": F.coalesce("item_qty", F.lit(0))})
        return etl.order_economics(joined, self.channels, self.zones)

    @cached_property
    def stored_orders(self) -> DataFrame:
        """The order fact written once, as a warehouse would hold it: for plans
        that reduce it more than once, so the line join is not repeated."""
        return stable(self.orders.select(
            "order_key", "date_key", "is_delivery", "is_cancelled", "is_late", "actual_min",
            "item_qty", "gross_amount", "discount_amount", "delivery_fee",
            "commission_amount", "net_revenue", "food_cost", "promo_code"), "orders")

    @cached_property
    def assumptions(self) -> DataFrame:
        text, dec = pa.string(), pa.decimal128(10, 4)
        items, eur = zip(*V.FIXED_COSTS_MONTHLY)
        fixed = literal_table(self.spark, {"cost_item": items, "monthly_eur": eur,
                                           "note": items},
                              {"cost_item": text, "monthly_eur": dec, "note": text})
        names, rates, bases = zip(*V.VARIABLE_COST_RATES)
        variable = literal_table(self.spark, {"cost_item": names, "rate": rates,
                                              "base": bases, "note": names},
                                 {"cost_item": text, "rate": dec, "base": text, "note": text})
        return etl.cost_table(fixed, variable)

    @cached_property
    def staffed_days(self) -> DataFrame:
        """Day totals with hours and waste, in one pass over the orders."""
        per_day = self.stored_orders.groupBy("date_key").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_delivery").alias("trips"),
            F.sum("food_cost").alias("food"), F.sum("gross_amount").alias("gross"),
            F.sum("net_revenue").alias("net"))
        u = F.unix_date(date_of_key("date_key"))
        wasted = ((10 + u % 26) / 1000).cast("decimal(4,3)")
        return per_day.filter(u % 41 != 0).select(
            "date_key", "gross", "net",
            ((1400 + F.col("n") * 21) / 100).cast("decimal(18,2)").alias("kitchen_hours"),
            ((400 + F.col("trips") * 25) / 100).cast("decimal(18,2)").alias("driver_hours"),
            money(F.round(F.col("food") * wasted, 2)).alias("waste_eur"))

    @cached_property
    def hours(self) -> DataFrame:
        return self.staffed_days.select("date_key", "kitchen_hours", "driver_hours",
                                        "waste_eur")

    @cached_property
    def shifts(self) -> DataFrame:
        return etl.cost_buckets(self.staffed_days, self.assumptions)

    @cached_property
    def kpi(self) -> DataFrame:
        return marts.kpi_daily(self.stored_orders, self.shifts, self.calendar)

    @cached_property
    def entry_log(self) -> DataFrame:
        return self.as_entry_log(self.raw("events"))

    @staticmethod
    def as_entry_log(raw: DataFrame) -> DataFrame:
        """The events as a log of form saves, keyed by day; also on a stream."""
        day = F.date_sub(F.col("ts").cast("date"), EVENT_SHIFT_DAYS)
        return raw.select(
            day.alias("business_date"), F.col("ts").cast("timestamp").alias("entered_at"),
            F.col("event_id").alias("seq"),
            F.col("event_type").alias("entered_by"), cents("value").alias("gross_revenue"),
            (F.col("user_id") % 40).alias("total_orders"))

    @cached_property
    def entries(self) -> DataFrame:
        """One form entry per event day."""
        kind = F.col("event_type")
        day = F.date_sub(F.col("ts").cast("date"), EVENT_SHIFT_DAYS).alias("business_date")
        per = self.raw("events").groupBy(day).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(kind == "purchase").alias("buys"),
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "error").alias("errors"), F.sum(cents("value")).alias("value"))
        u = F.unix_date("business_date")
        closed = u % 13 == 0
        total = F.when(closed | (u % 17 == 0), F.lit(0)).otherwise(
            F.col("buys") + F.col("views"))
        return per.select(
            "business_date", total.alias("total_orders"),
            money(F.when(closed | (u % 17 == 0) | (u % 11 == 0), F.lit(0))
                  .otherwise(F.col("value"))).alias("gross_revenue"),
            F.when(total == 0, F.lit(0)).otherwise(F.col("buys")).alias("delivery_orders"),
            F.when(total == 0, F.lit(0)).otherwise(F.col("views") - F.when(
                u % 7 == 0, F.lit(1)).otherwise(0)).alias("pickup_orders"),
            F.col("errors").alias("cancelled"),
            money(F.round(F.col("value") * F.lit("0.01").cast("decimal(3,2)"), 2))
            .alias("waste_eur"),
            F.when(u % 5 == 0, F.lit(0)).otherwise(30 + u % 9).cast("decimal(18,2)")
            .alias("staff_hours"),
            (12 + u % 4).cast("decimal(18,2)").alias("driver_hours"),
            (u % 7 == 2).alias("promo_active"),
            F.when(u % 7 == 2, "2for1").alias("promo_note"), closed.alias("is_closed"),
            (u % 3).cast("int").alias("complaints"), F.lit(None).cast("string").alias("notes"),
            F.lit("form").alias("entered_by"))
