"""Reporting marts. Facts are reduced to the mart key before any dimension is
joined; dimensions are joined without hints, so their measured size decides
between broadcast and shuffle."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import money, safe_ratio
from ..operators.combine import exclude_keys, union_tagged
from ..operators.stable import stable


def mart_dim_date(d: DataFrame) -> DataFrame:
    return d.select(
        "date_key", "full_date", "year", "quarter", "month", "month_name",
        "month_name_de", "iso_week", "day_of_week", "day_name", "day_name_de",
        "is_weekend", "is_public_holiday", "holiday_name", "is_school_holiday",
        "temp_mean_c", "temp_max_c", "precipitation_mm", "is_rainy", "is_cold",
        (F.col("year") * 100 + F.col("month")).alias("year_month_key"),
        F.col("month").alias("month_sort"), F.col("day_of_week").alias("weekday_sort"))


def mart_dim_item(i: DataFrame) -> DataFrame:
    unit = F.col("unit_price") - F.col("unit_cost")
    return i.select(
        "item_key", "item_name", "category",
        F.coalesce("size_name", F.lit("-")).alias("size_name"),
        F.when(F.col("size_name").isNull(), F.col("item_name"))
        .otherwise(F.concat("item_name", F.lit(" ("), "size_name", F.lit(")")))
        .alias("item_full_name"),
        "unit_price", "unit_cost", money(F.round(unit, 2)).alias("unit_margin"),
        safe_ratio(unit, "unit_price", 100, 1).alias("unit_margin_pct"),
        "is_vegetarian")


def zone_label():
    return F.concat("plz", F.lit(" "), "district_name")


def mart_dim_zone(z: DataFrame) -> DataFrame:
    return z.select("zone_key", "plz", "district_name", zone_label().alias("zone_label"),
                    "distance_km", "base_drive_min", "delivery_fee")


def mart_dim_channel(c: DataFrame) -> DataFrame:
    return c.select("channel_key", "channel_name", "is_aggregator", "commission_rate",
                    F.when(F.col("is_aggregator"), "Aggregator").otherwise("Direkt")
                    .alias("channel_group"))


def mart_dim_driver(d: DataFrame) -> DataFrame:
    return d.select("driver_key", "driver_name", "vehicle")


def mart_fct_order(o: DataFrame) -> DataFrame:
    return o.select(
        "order_key", "date_key", "order_ts", "daypart", "customer_key", "channel_key",
        "zone_key", "driver_key", "is_delivery", "is_cancelled", "item_qty",
        "gross_amount", "discount_amount", "delivery_fee", "commission_amount",
        "net_revenue", "food_cost",
        money(F.round(F.col("net_revenue") - F.col("food_cost"), 2)).alias("gross_margin"),
        "promised_min", "actual_min", "is_late", "promo_code",
        F.coalesce(F.col("discount_amount") > 0, F.lit(False)).alias("has_discount"))


def mart_fct_order_item(lines: DataFrame) -> DataFrame:
    return lines.select(
        "order_item_key", "order_key", "date_key", "item_key", "quantity",
        "line_revenue", "line_cost",
        money(F.round(F.col("line_revenue") - F.col("line_cost"), 2)).alias("line_margin"))


def mart_cost_assumption(a: DataFrame) -> DataFrame:
    return a.select(
        "cost_item", "cost_type", "monthly_eur", "pct_of_revenue",
        money(F.round(F.coalesce("monthly_eur", F.lit(0)) * 12, 2)).alias("annual_eur"),
        "note")


ENTRY_FIELDS = ["business_date", "total_orders", "gross_revenue", "delivery_orders",
                "pickup_orders", "cancelled", "waste_eur", "staff_hours", "driver_hours",
                "promo_active", "promo_note", "is_closed", "complaints", "notes",
                "entered_by"]


def mart_daily_entry(e: DataFrame) -> DataFrame:
    return e.select(*ENTRY_FIELDS)


def _open_orders(orders, exclude_cancelled):
    return orders.filter(~F.col("is_cancelled")) if exclude_cancelled else orders


KPI_CALENDAR = ["full_date", "year", "month", "month_name", "month_name_de", "iso_week",
                "day_of_week", "day_name", "day_name_de", "is_weekend",
                "is_public_holiday", "is_school_holiday", "temp_mean_c",
                "precipitation_mm", "is_rainy"]
COST_BUCKETS = ["labour_cost", "waste_eur", "packaging_cost", "payment_fees",
                "fixed_cost", "royalty_cost"]


def orders_by_day(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-side day totals; one scan, one shuffle of partial sums."""
    trip = F.col("is_delivery")
    return orders.groupBy(*by, "date_key").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(trip).alias("delivery_orders"),
        (F.count(F.lit(1)) - F.count_if(trip)).alias("pickup_orders"),
        F.count_if("is_cancelled").alias("cancelled_orders"),
        F.sum("item_qty").alias("items_sold"),
        *[F.sum(c).alias(n) for c, n in [
            ("gross_amount", "gross_revenue"), ("discount_amount", "discount_total"),
            ("delivery_fee", "delivery_fee_total"), ("commission_amount", "commission_total"),
            ("net_revenue", "net_revenue"), ("food_cost", "food_cost")]],
        F.sum(F.when(trip, F.col("actual_min"))).alias("_minutes"),
        F.count(F.when(trip, F.col("actual_min"))).alias("_timed"),
        F.count_if(trip & F.col("is_late")).alias("_late"))


def kpi_daily(orders: DataFrame, shifts: DataFrame, calendar: DataFrame,
              by: Sequence[str] = (), exclude_cancelled: bool = False) -> DataFrame:
    """One row per trading day with the full cost stack.

    Days without orders are absent; a day without a cost row costs 0. Note
    the denominators: food and labour percent are of gross revenue, margins
    and break-even load of net revenue.
    """
    by = list(by)
    day = orders_by_day(_open_orders(orders, exclude_cancelled), by)
    cost = shifts.select(*by, "date_key", "kitchen_hours", "driver_hours", *COST_BUCKETS)
    wide = (day.join(calendar.select("date_key", *KPI_CALENDAR), "date_key")
            .join(cost, [*by, "date_key"], "left"))
    wide = wide.withColumns({c: money(F.coalesce(c, F.lit(0))) for c in COST_BUCKETS})
    running = ["food_cost", "labour_cost", "waste_eur", "packaging_cost", "payment_fees"]
    contribution = F.col("net_revenue")
    for c in running:
        contribution = contribution - F.col(c)
    operating = contribution - F.col("fixed_cost") - F.col("royalty_cost")
    return wide.select(
        *by, "date_key", *KPI_CALENDAR,
        "orders", "delivery_orders", "pickup_orders", "cancelled_orders", "items_sold",
        *[money(F.round(c, 2)).alias(c) for c in [
            "gross_revenue", "discount_total", "delivery_fee_total", "commission_total",
            "net_revenue", "food_cost"]],
        *COST_BUCKETS, "kitchen_hours", "driver_hours",
        money(F.round(contribution, 2)).alias("contribution_margin"),
        safe_ratio(contribution, "net_revenue", 100, 1).alias("contribution_margin_pct"),
        money(F.round(operating, 2)).alias("operating_profit"),
        safe_ratio(operating, "net_revenue", 100, 1).alias("operating_margin_pct"),
        safe_ratio(F.col("fixed_cost") + F.col("labour_cost"), "net_revenue", 100, 1)
        .alias("breakeven_load_pct"),
        safe_ratio("gross_revenue", "orders").alias("avg_order_value"),
        safe_ratio("food_cost", "gross_revenue", 100, 1).alias("food_cost_pct"),
        safe_ratio("labour_cost", "gross_revenue", 100, 1).alias("labour_cost_pct"),
        safe_ratio("delivery_orders", "orders", 100, 1).alias("delivery_share_pct"),
        safe_ratio("_minutes", "_timed", 1, 1).alias("avg_delivery_min"),
        safe_ratio("_late", "delivery_orders", 100, 1).alias("late_rate_pct"),
        safe_ratio("orders", "kitchen_hours").alias("orders_per_kitchen_hour"),
        safe_ratio("delivery_orders", "driver_hours").alias("orders_per_driver_hour"))


def kpi_zone(orders: DataFrame, zones: DataFrame, exclude_cancelled: bool = False) -> DataFrame:
    """Deliveries per zone; margin is per minute on the road."""
    per_zone = (_open_orders(orders, exclude_cancelled).filter("is_delivery")
                .groupBy("zone_key").agg(
                    F.count(F.lit(1)).alias("orders"),
                    F.sum("gross_amount").alias("_gross"),
                    F.count("gross_amount").alias("_priced"),
                    F.sum("net_revenue").alias("_net"), F.sum("food_cost").alias("_food"),
                    F.sum("actual_min").alias("_minutes"),
                    F.count("actual_min").alias("_timed"),
                    F.count_if("is_late").alias("_late")))
    margin = F.col("_net") - F.col("_food")
    return per_zone.join(zones, "zone_key").select(
        "zone_key", "plz", "district_name", zone_label().alias("zone_label"),
        "distance_km", "orders", money("_gross").alias("gross_revenue"),
        money("_net").alias("net_revenue"), money(margin).alias("gross_margin"),
        safe_ratio("_gross", "_priced").alias("avg_order_value"),
        safe_ratio("_minutes", "_timed", 1, 1).alias("avg_delivery_min"),
        safe_ratio("_late", "orders", 100, 1).alias("late_rate_pct"),
        safe_ratio(margin, "_minutes", 1, 3).alias("margin_per_drive_minute"))


def kpi_item(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Menu figures per item. The distinct order count first removes repeats
    per (item, order), so a best-seller is spread over many tasks."""
    per_item = lines.groupBy("item_key").agg(
        F.sum("quantity").alias("units_sold"), F.sum("line_revenue").alias("_rev"),
        F.sum("line_cost").alias("_cost"),
        F.countDistinct("order_key").alias("orders_containing"))
    margin = F.col("_rev") - F.col("_cost")
    return per_item.join(items, "item_key").select(
        "item_key", "item_name", "category",
        F.coalesce("size_name", F.lit("-")).alias("size_name"), "unit_price",
        "units_sold", money("_rev").alias("revenue"), money(margin).alias("margin"),
        safe_ratio(margin, "_rev", 100, 1).alias("margin_pct"), "orders_containing")


def kpi_channel_daily(orders: DataFrame, channels: DataFrame, calendar: DataFrame,
                      exclude_cancelled: bool = False) -> DataFrame:
    per = (_open_orders(orders, exclude_cancelled)
           .groupBy("date_key", "channel_key").agg(
               F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("_gross"),
               F.count("gross_amount").alias("_priced"),
               F.sum("commission_amount").alias("_comm"),
               F.sum("net_revenue").alias("_net"), F.sum("food_cost").alias("_food")))
    return (per.join(channels, "channel_key")
            .join(calendar.select("date_key", "full_date"), "date_key")
            .select("date_key", "full_date", "channel_key", "channel_name", "is_aggregator",
                    "orders", money("_gross").alias("gross_revenue"),
                    money("_comm").alias("commission"), money("_net").alias("net_revenue"),
                    money(F.col("_net") - F.col("_food")).alias("gross_margin"),
                    safe_ratio("_gross", "_priced").alias("avg_order_value")))


def customer_base(customers: DataFrame, orders: DataFrame, calendar: DataFrame) -> DataFrame:
    """Customers with their history; none is lost: no orders means count 0
    and NULL spend. The fact meets no other table before it is one row per
    customer; the last date comes from the last date key."""
    history = orders.filter(F.col("customer_key").isNotNull()).groupBy("customer_key").agg(
        F.count("order_key").alias("_orders"), F.sum("gross_amount").alias("_spend"),
        F.count("gross_amount").alias("_priced"), F.max("date_key").alias("date_key"))
    history = history.join(calendar.select(
        "date_key", F.col("full_date").alias("last_order_date")), "date_key", "left")
    return customers.join(history, "customer_key", "left").select(
        "customer_key", "customer_code", "zone_key", "signup_channel", "first_order_date",
        F.coalesce("_orders", F.lit(0)).alias("total_orders"),
        money("_spend").alias("total_spend"),
        safe_ratio("_spend", "_priced").alias("avg_order_value"), "last_order_date")


def daily_actuals(kpi: DataFrame, entries: DataFrame) -> DataFrame:
    """History and form entries on their shared columns; history wins."""
    history = kpi.select(
        F.col("full_date").alias("business_date"), F.col("orders").alias("total_orders"),
        "gross_revenue", "delivery_orders", "pickup_orders", "waste_eur",
        F.col("kitchen_hours").alias("staff_hours"), "driver_hours", "avg_order_value",
        "operating_profit", F.lit(False).alias("is_closed"))
    # one row per day, read twice: stored, so that the KPIs are made once
    history = stable(history, "history")
    form = exclude_keys(entries, history, "business_date").select(
        "business_date", "total_orders", "gross_revenue", "delivery_orders",
        "pickup_orders", "waste_eur", "staff_hours", "driver_hours",
        safe_ratio("gross_revenue", "total_orders").alias("avg_order_value"), "is_closed")
    return union_tagged({"history": history, "form": form})
