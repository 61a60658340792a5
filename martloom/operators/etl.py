"""Deterministic transforms that turn raw inputs into the star schema."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions import clean_nan, date_key_of, money, names_of
from .combine import flag_members, span_days
from .series import fill_gaps


def calendar_of(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per day of the single interval in ``bounds``."""
    day = F.col("full_date")
    dow = F.weekday(day) + 1
    return (bounds.select(F.explode(F.sequence(start, end)).alias("full_date"))
            .select(
                date_key_of(day).alias("date_key"), day,
                F.year(day).alias("year"), F.quarter(day).alias("quarter"),
                F.month(day).alias("month"),
                names_of(F.month(day), V.MONTHS_EN).alias("month_name"),
                names_of(F.month(day), V.MONTHS_DE).alias("month_name_de"),
                F.weekofyear(day).alias("iso_week"),
                F.dayofmonth(day).alias("day_of_month"), dow.alias("day_of_week"),
                names_of(dow, V.DAYS_EN).alias("day_name"),
                names_of(dow, V.DAYS_DE).alias("day_name_de"),
                dow.isin(6, 7).alias("is_weekend")))


def build_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    return calendar_of(spark.range(1).select(F.lit(start).cast("date").alias("start"),
                                             F.lit(end).cast("date").alias("end")))


def with_holidays(calendar: DataFrame, holidays: DataFrame, spans: DataFrame) -> DataFrame:
    """Public holidays from (holiday_date, holiday_name), school holidays from
    inclusive (start, end) spans."""
    named = holidays.groupBy(F.col("holiday_date").alias("full_date")).agg(
        F.min("holiday_name").alias("holiday_name"))
    out = calendar.join(named, "full_date", "left").withColumn(
        "is_public_holiday", F.col("holiday_name").isNotNull())
    return flag_members(out, span_days(spans, day="full_date"), "full_date",
                        "is_school_holiday")


def with_weather(calendar: DataFrame, weather: DataFrame, rain_mm=V.RAINY_ABOVE_MM,
                 cold_c=V.COLD_BELOW_C) -> DataFrame:
    """Carry the last observation forward, then join on the date. A missing
    measurement is neither rainy nor cold."""
    values = [c for c in weather.columns if c != "full_date"]
    floats = {c for c, t in weather.dtypes if t in ("double", "float")}
    clean = weather.select("full_date", *[
        clean_nan(c).alias(c) if c in floats else F.col(c) for c in values])
    filled = fill_gaps(clean, "full_date", values)
    return (calendar.join(filled, "full_date", "left")
            .withColumn("is_rainy", F.coalesce(F.col("precipitation_mm") > rain_mm,
                                               F.lit(False)))
            .withColumn("is_cold", F.coalesce(F.col("temp_mean_c") < cold_c,
                                              F.lit(False))))


def rollup_lines(lines: DataFrame) -> DataFrame:
    """Order lines to order totals; combines map-side, so a huge order is fine."""
    return lines.groupBy("order_key").agg(
        F.sum("line_revenue").alias("gross_amount"),
        F.sum("line_cost").alias("food_cost"),
        F.sum("line_discount").alias("discount_amount"),
        F.sum("quantity").alias("item_qty"))


def order_economics(orders: DataFrame, channels: DataFrame, zones: DataFrame) -> DataFrame:
    """Delivery fee, commission and net revenue of every order."""
    after = F.col("gross_amount") - F.col("discount_amount")
    return (orders
            .join(channels.select("channel_key", "commission_rate"), "channel_key", "left")
            .join(zones.select("zone_key", F.col("delivery_fee").alias("_fee")),
                  "zone_key", "left")
            .withColumn("delivery_fee", money(
                F.when(F.col("is_delivery"), F.coalesce("_fee", F.lit(0))).otherwise(0)))
            .withColumn("commission_amount", money(
                F.round(F.coalesce("commission_rate", F.lit(0)) * after, 2)))
            .withColumn("net_revenue", money(
                after + F.col("delivery_fee") - F.col("commission_amount")))
            .drop("_fee", "commission_rate"))


def cost_table(fixed: DataFrame, variable: DataFrame) -> DataFrame:
    """Fixed (item, monthly_eur, note) and variable (item, rate, base, note)
    cost lines as one assumption table."""
    return (fixed.select("cost_item", F.lit("fix").alias("cost_type"),
                         F.col("monthly_eur").cast("decimal(10,2)").alias("monthly_eur"),
                         F.lit(None).cast("decimal(6,4)").alias("pct_of_revenue"), "note")
            .unionByName(variable.select(
                "cost_item", F.lit("variabel").alias("cost_type"),
                F.lit(None).cast("decimal(10,2)").alias("monthly_eur"),
                F.col("rate").cast("decimal(6,4)").alias("pct_of_revenue"),
                F.concat("note", F.lit(" ("), "base", F.lit(")")).alias("note"))))


def cost_buckets(days: DataFrame, assumptions: DataFrame,
                 roles: Mapping[str, str] | None = None, kitchen_wage=V.KITCHEN_WAGE,
                 driver_wage=V.DRIVER_WAGE, cashless_share=V.CASHLESS_SHARE) -> DataFrame:
    """Operating cost buckets from day totals.

    ``days`` holds (date_key, gross, net, kitchen_hours, driver_hours,
    waste_eur); ``assumptions`` is the cost table, read as one scalar row;
    ``roles`` maps each variable cost item to packaging, payment or royalty.
    """
    roles = roles or dict(zip([i for i, _, _ in V.VARIABLE_COST_RATES],
                              ["packaging", "payment", "royalty", "royalty"]))

    def rate(role):
        items = [i for i, r in roles.items() if r == role]
        return F.coalesce(F.sum(F.when(F.col("cost_item").isin(items),
                                       F.col("pct_of_revenue"))), F.lit(0)).alias(role)

    rates = assumptions.agg(F.struct(
        F.sum("monthly_eur").alias("fixed"), rate("packaging"), rate("payment"),
        rate("royalty")).alias("r")).scalar()
    labour = (F.col("kitchen_hours") * F.lit(kitchen_wage)
              + F.col("driver_hours") * F.lit(driver_wage))
    return days.withColumn("_r", rates).select(
        F.col("date_key").cast("long").alias("shift_key"), "date_key",
        F.col("kitchen_hours").cast("decimal(18,2)").alias("kitchen_hours"),
        F.col("driver_hours").cast("decimal(18,2)").alias("driver_hours"),
        money(F.round(labour, 2)).alias("labour_cost"),
        money("waste_eur").alias("waste_eur"),
        money(F.round(F.col("gross") * F.col("_r.packaging"), 2)).alias("packaging_cost"),
        money(F.round(F.col("gross") * F.lit(cashless_share) * F.col("_r.payment"), 2))
        .alias("payment_fees"),
        money(F.round(F.col("_r.fixed") * 12 / 365, 2)).alias("fixed_cost"),
        money(F.round(F.col("net") * F.col("_r.royalty"), 2)).alias("royalty_cost"))


def daily_costs(orders: DataFrame, hours: DataFrame, assumptions: DataFrame,
                **options) -> DataFrame:
    """Cost buckets per trading day from orders and (date_key, kitchen_hours,
    driver_hours, waste_eur)."""
    days = orders.groupBy("date_key").agg(F.sum("gross_amount").alias("gross"),
                                          F.sum("net_revenue").alias("net"))
    return cost_buckets(days.join(hours, "date_key"), assumptions, **options)


def entries_from_orders(orders: DataFrame, shifts: DataFrame, calendar: DataFrame,
                        promo_note: str = "2for1", entered_by: str = "backfill") -> DataFrame:
    """Back-fill of the nightly form from order history."""
    days = orders.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("gross_amount").alias("gross_revenue"),
        F.count_if("is_delivery").alias("delivery_orders"),
        F.count_if("is_cancelled").alias("cancelled"),
        F.bool_or(F.col("promo_code").isNotNull()).alias("promo_active"))
    return (days.join(shifts.select("date_key", "kitchen_hours", "driver_hours",
                                    "waste_eur"), "date_key")
            .join(calendar.select("date_key", "full_date"), "date_key")
            .select(
                F.col("full_date").alias("business_date"), "total_orders",
                money("gross_revenue").alias("gross_revenue"), "delivery_orders",
                (F.col("total_orders") - F.col("delivery_orders")).alias("pickup_orders"),
                "cancelled", "waste_eur", F.col("kitchen_hours").alias("staff_hours"),
                "driver_hours", "promo_active",
                F.when(F.col("promo_active"), promo_note).alias("promo_note"),
                (F.col("total_orders") == 0).alias("is_closed"),
                F.lit(0).alias("complaints"), F.lit(None).cast("string").alias("notes"),
                F.lit(entered_by).alias("entered_by")))


def with_first_order(customers: DataFrame, orders: DataFrame, calendar: DataFrame) -> DataFrame:
    """First order date on the customer; orders are reduced before the join."""
    first = (orders.groupBy("customer_key").agg(F.min("date_key").alias("date_key"))
             .join(calendar.select("date_key", "full_date"), "date_key")
             .select("customer_key", F.col("full_date").alias("first_order_date")))
    return customers.drop("first_order_date").join(first, "customer_key", "left")
