"""The questions dashboards ask of the marts."""

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import money, safe_ratio
from ..operators.aggregate import group_quantiles, share_of_total, value_counts
from ..operators.combine import unpivot_lines
from ..operators.order import top_k
from ..operators.stable import stable
from ..operators.series import (in_period, period_change, trailing_mean_days,
                                trailing_mean_rows, with_lag_days, year_to_date)


def headline(kpi: DataFrame, lo, hi) -> DataFrame:
    """Revenue, orders, order value, profit and margin over a date range."""
    t = in_period(kpi, "full_date", lo, hi).agg(
        F.count(F.lit(1)).alias("days"), F.sum("gross_revenue").alias("_gross"),
        F.sum("orders").alias("orders"), F.sum("operating_profit").alias("_profit"),
        F.sum("net_revenue").alias("_net"))
    return t.select(
        "days", money("_gross").alias("revenue"), "orders",
        safe_ratio("_gross", F.greatest("orders", F.lit(1))).alias("avg_order_value"),
        money("_profit").alias("operating_profit"),
        safe_ratio("_profit", F.greatest("_net", F.lit(1)), 100, 1)
        .alias("operating_margin_pct"))


def revenue_trend(kpi: DataFrame, n: int = 7) -> DataFrame:
    return trailing_mean_rows(kpi.select("full_date", "gross_revenue"), "full_date",
                              "gross_revenue", n, out="avg_7_rows")


def weekday_profile(kpi: DataFrame) -> DataFrame:
    return (kpi.groupBy("day_of_week", "day_name").agg(F.avg("orders").alias("avg_orders"))
            .orderBy("day_of_week"))


def rain_split(kpi: DataFrame) -> DataFrame:
    return (kpi.filter(F.col("is_rainy").isNotNull())
            .groupBy(F.when(F.col("is_rainy"), "Rainy").otherwise("Dry").alias("weather"))
            .agg(F.avg("orders").alias("avg_orders")))


def pnl_lines(kpi: DataFrame) -> DataFrame:
    """Signed P&L lines, the total, and each as percent of net revenue."""
    costs = {"Food cost": "food_cost", "Packaging": "packaging_cost", "Waste": "waste_eur",
             "Labour": "labour_cost", "Payment fees": "payment_fees",
             "Fixed costs": "fixed_cost", "Franchise fees": "royalty_cost"}
    t = kpi.agg(F.sum("net_revenue").alias("_net"),
                *[F.sum(c).alias(c) for c in costs.values()])
    lines = {"Net revenue": F.col("_net"), **{n: -F.col(c) for n, c in costs.items()}}
    total = F.col("_net")
    for c in costs.values():
        total = total - F.col(c)
    lines["= Operating profit"] = total
    rows = unpivot_lines(t, {n: money(e) for n, e in lines.items()}, "line", "eur",
                         keep=["_net"])
    return rows.select("line", "eur",
                       safe_ratio("eur", "_net", 100, 1).alias("pct_of_net_revenue"))


def zone_table(kz: DataFrame) -> DataFrame:
    return kz.select("plz", "district_name", "distance_km", "orders", "avg_order_value",
                     "avg_delivery_min", "late_rate_pct", "margin_per_drive_minute"
                     ).orderBy("distance_km", "plz")


def forecast_totals(f: DataFrame) -> DataFrame:
    return f.agg(F.sum("orders_forecast").alias("orders"),
                 money(F.sum("revenue_forecast")).alias("revenue"))


def item_ranking(ki: DataFrame) -> DataFrame:
    return ki.select("item_key", "item_name", "category", "size_name", "unit_price",
                     "units_sold", "revenue", "margin", "margin_pct"
                     ).orderBy(F.col("revenue").desc(), "item_key")


def category_revenue(ki: DataFrame) -> DataFrame:
    return ki.groupBy("category").agg(money(F.sum("revenue")).alias("revenue"))


def daily_log(actuals: DataFrame, n: int = 30) -> DataFrame:
    return top_k(actuals.select("business_date", "total_orders", "gross_revenue",
                                "avg_order_value", "delivery_orders", "pickup_orders",
                                "staff_hours", "source"),
                 [F.col("business_date").desc()], n)


def source_counts(actuals: DataFrame) -> DataFrame:
    return value_counts(actuals, "source")


def week_on_week(kpi: DataFrame) -> DataFrame:
    return period_change(kpi.select("full_date", "gross_revenue"), "full_date",
                         "gross_revenue", 7, out="wow_pct").withColumnRenamed(
                             "gross_revenue_7d_ago", "revenue_last_week")


def trailing_and_ytd(kpi: DataFrame) -> DataFrame:
    seven = trailing_mean_days(kpi.select("full_date", "gross_revenue"), "full_date",
                               "gross_revenue", 7, out="avg_7_days")
    return year_to_date(seven, "full_date", "gross_revenue", out="revenue_ytd")


def delivery_headline(orders: DataFrame) -> DataFrame:
    """From the order fact, so that busy days weigh more than quiet ones."""
    t = orders.agg(F.sum("actual_min").alias("_m"), F.count("actual_min").alias("_t"),
                   F.count_if("is_late").alias("late_orders"),
                   F.count_if("is_delivery").alias("deliveries"))
    return t.select("deliveries", "late_orders",
                    safe_ratio("_m", "_t", 1, 2).alias("avg_delivery_min"),
                    safe_ratio("late_orders", "deliveries", 1, 4).alias("late_rate"))


def channel_economics(kc: DataFrame) -> DataFrame:
    """Commission, revenue share and margin per order of every channel."""
    per = kc.groupBy("channel_key", "channel_name", "is_aggregator").agg(
        F.sum("orders").alias("orders"), money(F.sum("gross_revenue")).alias("gross_revenue"),
        money(F.sum("commission")).alias("commission"),
        money(F.sum("gross_margin")).alias("gross_margin"))
    return (share_of_total(per, "gross_revenue", "revenue_share_pct", scale=100, places=1)
            .withColumn("margin_per_order", safe_ratio("gross_margin", "orders")))


def aggregator_share(kc: DataFrame) -> DataFrame:
    t = kc.agg(F.sum(F.when(F.col("is_aggregator"), F.col("gross_revenue"))).alias("_a"),
               F.sum("gross_revenue").alias("_g"), F.sum("commission").alias("_c"))
    return t.select(money("_c").alias("commission_paid"),
                    safe_ratio("_a", "_g", 100, 1).alias("aggregator_share_pct"))


def entry_summary(entries: DataFrame, kitchen_wage=V.KITCHEN_WAGE,
                  driver_wage=V.DRIVER_WAGE) -> DataFrame:
    """Each entry against the same weekday a week before."""
    e = with_lag_days(entries, "business_date", "total_orders", 7, out="_o")
    e = with_lag_days(e, "business_date", "gross_revenue", 7, out="_r")
    wages = (F.col("staff_hours") * F.lit(kitchen_wage)
             + F.col("driver_hours") * F.lit(driver_wage))
    return e.select(
        "business_date", "total_orders", "gross_revenue",
        safe_ratio(F.col("total_orders") - F.col("_o"), "_o", 100, 0)
        .alias("orders_change_pct"),
        safe_ratio(F.col("gross_revenue") - F.col("_r"), "_r", 100, 0)
        .alias("revenue_change_pct"),
        safe_ratio("gross_revenue", "total_orders").alias("avg_order_value"),
        safe_ratio("delivery_orders", "total_orders", 100, 0).alias("delivery_share_pct"),
        safe_ratio(F.round(wages, 2), "gross_revenue", 100, 0).alias("labour_pct"),
        "waste_eur")


def menu_quadrant(ki: DataFrame) -> DataFrame:
    """Items split at the median units and the median margin percent (the
    latter has a bounded domain: tenths of a percent)."""
    ki = stable(ki, "items")
    units = group_quantiles(ki, [], "units_sold", [0.5], ["m"], wide_domain=True)
    margin = group_quantiles(ki, [], "margin_pct", [0.5], ["m"])
    high_units = F.col("units_sold") >= F.col("_u")
    high_margin = F.col("margin_pct") >= F.col("_m")
    return (ki.withColumn("_u", units.scalar()).withColumn("_m", margin.scalar())
            .select("item_key", "item_name", "units_sold", "margin_pct",
                    F.when(high_units & high_margin, "star")
                    .when(high_units, "workhorse")
                    .when(high_margin, "puzzle").otherwise("dead weight")
                    .alias("quadrant")))
