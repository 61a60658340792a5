"""Projections, ETL transforms and marts."""

from pyspark.sql import functions as F


from martloom.functions import is_late, late_minutes_over
from martloom.operators import etl
from martloom.plans import marts

from .oracle_base import day, eur, ratio, sql
from .registry import query

# ------------------------------------------------------------- projections


@query("prj_1_mart_dim_date", sql("cal", f"""
SELECT date_key, {day('full_date')}, year, quarter, month, month_name, month_name_de, iso_week,
  day_of_week, day_name, day_name_de, is_weekend, is_public_holiday, holiday_name,
  is_school_holiday, temp_mean_c, temp_max_c, precipitation_mm, is_rainy, is_cold,
  year * 100 + month AS year_month_key, month AS month_sort, day_of_week AS weekday_sort FROM cal"""))
def prj_1(s):
    return marts.mart_dim_date(s.calendar)


@query("prj_2_mart_dim_item", sql("item", f"""
SELECT item_key, item_name, category, coalesce(size_name, '-') AS size_name,
  CASE WHEN size_name IS NULL THEN item_name ELSE item_name || ' (' || size_name || ')' END
    AS item_full_name, {eur('price_c')} AS unit_price, {eur('cost_c')} AS unit_cost,
  {eur('price_c - cost_c')} AS unit_margin,
  {ratio('price_c - cost_c', 'price_c', 100, 1)} AS unit_margin_pct, is_vegetarian FROM item"""))
def prj_2(s):
    return marts.mart_dim_item(s.items)


@query("prj_3_mart_dim_zone", sql("zone", f"""
SELECT zone_key, plz, district_name, plz || ' ' || district_name AS zone_label,
  CAST(km AS DOUBLE) AS distance_km, CAST(4 + km * 2 AS DOUBLE) AS base_drive_min,
  {eur('fee_c')} AS delivery_fee FROM zone"""))
def prj_3(s):
    return marts.mart_dim_zone(s.zones)


@query("prj_4_mart_dim_channel", sql("head channel", """
SELECT c.channel_key, channel_name, is_aggregator, CAST(rate_pct AS DOUBLE) / 100 AS commission_rate,
  CASE WHEN is_aggregator THEN 'Aggregator' ELSE 'Direkt' END AS channel_group
FROM channel c WHERE channel_key IN (SELECT channel_key FROM head)"""))
def prj_4(s):
    used = s.order_heads.select("channel_key").distinct()
    return marts.mart_dim_channel(s.channels.join(used, "channel_key", "left_semi"))


@query("prj_5_mart_dim_driver", """
SELECT s_suppkey + 1 AS driver_key, s_name AS driver_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'Roller' WHEN 1 THEN 'Auto' ELSE 'Fahrrad' END AS vehicle
FROM supplier""")
def prj_5(s):
    return marts.mart_dim_driver(s.drivers)


ORDER_MONEY = f"""{eur('gross_c')} AS gross_amount, {eur('disc_c')} AS discount_amount,
  {eur('fee_c')} AS delivery_fee, {eur('comm_c')} AS commission_amount, {eur('net_c')} AS net_revenue,
  {eur('food_c')} AS food_cost"""


@query("prj_6_mart_fct_order", sql("ord", f"""
SELECT order_key, date_key, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts, daypart,
  customer_key, channel_key, zone_key, driver_key, is_delivery, is_cancelled, item_qty,
  {ORDER_MONEY}, {eur('net_c - food_c')} AS gross_margin,
  CASE WHEN is_delivery THEN 45 END AS promised_min, actual_min, is_late, promo_code,
  disc_c > 0 AS has_discount FROM ord"""))
def prj_6(s):
    return marts.mart_fct_order(s.orders)


@query("prj_7_mart_fct_order_item", sql("line head", f"""
SELECT row_number() OVER (ORDER BY order_key, item_key, quantity, rev_c, cost_c, disc_c)
    AS order_item_key, order_key, date_key, item_key, quantity, {eur('rev_c')} AS line_revenue,
  {eur('cost_c')} AS line_cost, {eur('rev_c - cost_c')} AS line_margin
FROM line JOIN (SELECT order_key, date_key FROM head) USING (order_key)"""))
def prj_7(s):
    return marts.mart_fct_order_item(s.order_lines)


@query("prj_8_cost_assumption", sql("assume ord", f"""
SELECT cost_item, cost_type, monthly_eur, pct_of_revenue, coalesce(monthly_eur, 0) * 12 AS annual_eur,
  note, {eur('(SELECT sum(net_c) FROM ord)')} AS net_revenue FROM assume"""))
def prj_8(s):
    net = s.orders.agg(F.sum("net_revenue").alias("n")).scalar()
    return marts.mart_cost_assumption(s.assumptions).withColumn("net_revenue", net)


ENTRY = f"""{day('business_date')}, total_orders, {eur('gross_c')} AS gross_revenue,
  delivery_orders, pickup_orders, cancelled, {eur('waste_c')} AS waste_eur,
  {eur('staff_h')} AS staff_hours, {eur('driver_h')} AS driver_hours, promo_active, promo_note,
  is_closed, complaints, notes, entered_by"""


@query("prj_9_mart_daily_entry", sql("entry", f"SELECT {ENTRY} FROM entry"))
def prj_9(s):
    return marts.mart_daily_entry(s.entries)


# --------------------------------------------------------------------- ETL


@query("etl_1_build_calendar", sql("cal", f"""
SELECT date_key, {day('full_date')}, year, quarter, month, month_name, month_name_de, iso_week,
  day_of_month, day_of_week, day_name, day_name_de, is_weekend FROM cal"""))
def etl_1(s):
    return etl.calendar_of(s.bounds)


@query("etl_2_holidays", sql("cal", f"""
SELECT {day('full_date')}, is_public_holiday, holiday_name, is_school_holiday FROM cal"""))
def etl_2(s):
    return etl.with_holidays(s.plain_calendar, s.holidays, s.spans).select(
        "full_date", "is_public_holiday", "holiday_name", "is_school_holiday")


@query("etl_3_weather", sql("cal", f"""
SELECT {day('full_date')}, temp_mean_c, temp_max_c, precipitation_mm, wind_max_kmh, is_rainy,
  is_cold FROM cal"""))
def etl_3(s):
    return etl.with_weather(s.plain_calendar.select("full_date"), s.weather)


@query("etl_4_order_economics", sql("ord", f"""
SELECT order_key, channel_key, {ORDER_MONEY} FROM ord"""))
def etl_4(s):
    return s.orders.select("order_key", "channel_key", "gross_amount", "discount_amount",
                           "delivery_fee", "commission_amount", "net_revenue", "food_cost")


@query("etl_5_rollup_lines", sql("line", f"""
SELECT order_key, {eur('sum(rev_c)')} AS gross_amount, {eur('sum(cost_c)')} AS food_cost,
  {eur('sum(disc_c)')} AS discount_amount, CAST(sum(quantity) AS BIGINT) AS item_qty
FROM line GROUP BY order_key"""))
def etl_5(s):
    return etl.rollup_lines(s.lines)


@query("etl_6_daily_costs", sql("shift", f"""
SELECT CAST(date_key AS BIGINT) AS shift_key, date_key, {eur('kitchen_h')} AS kitchen_hours,
  {eur('driver_h')} AS driver_hours, {eur('labour_c')} AS labour_cost, {eur('waste_c')} AS waste_eur,
  {eur('pack_c')} AS packaging_cost, {eur('pay_c')} AS payment_fees, {eur('fixed_c')} AS fixed_cost,
  {eur('royal_c')} AS royalty_cost FROM shift"""))
def etl_6(s):
    return etl.daily_costs(s.stored_orders, s.hours, s.assumptions)


@query("etl_7_entries_from_orders", sql("ord hrs cal", f"""
SELECT {day('c.full_date', 'business_date')}, o.n AS total_orders, {eur('o.g')} AS gross_revenue,
  o.trips AS delivery_orders, o.n - o.trips AS pickup_orders, o.cancelled,
  {eur('h.waste_c')} AS waste_eur, {eur('h.kitchen_h')} AS staff_hours,
  {eur('h.driver_h')} AS driver_hours, o.promo AS promo_active,
  CASE WHEN o.promo THEN '2for1' END AS promo_note, o.n = 0 AS is_closed,
  0 AS complaints, CAST(NULL AS VARCHAR) AS notes, 'backfill' AS entered_by
FROM (SELECT date_key, count(*) AS n, sum(gross_c) AS g, count(*) FILTER (WHERE is_delivery) AS trips,
        count(*) FILTER (WHERE is_cancelled) AS cancelled, bool_or(promo_code IS NOT NULL) AS promo
      FROM ord GROUP BY date_key) o JOIN hrs h USING (date_key) JOIN cal c USING (date_key)"""))
def etl_7(s):
    return etl.entries_from_orders(s.stored_orders, s.hours, s.calendar)


@query("etl_8_first_order_date", sql("cust head", f"""
SELECT customer_key, customer_code, zone_key, signup_channel, {day('first', 'first_order_date')}
FROM cust LEFT JOIN (SELECT customer_key, min(full_date) AS first FROM head GROUP BY 1)
USING (customer_key)"""))
def etl_8(s):
    return etl.with_first_order(s.customers, s.order_heads, s.plain_calendar)


@query("etl_9_daypart", sql("ord", """
SELECT daypart, count(*) AS orders, min(strftime(order_ts, '%H:%M')) AS earliest,
  max(strftime(order_ts, '%H:%M')) AS latest FROM ord GROUP BY daypart"""))
def etl_9(s):
    from martloom.functions import daypart
    clock = F.date_format("order_ts", "HH:mm")
    return (s.order_heads.groupBy(daypart("order_ts").alias("daypart"))
            .agg(F.count(F.lit(1)).alias("orders"), F.min(clock).alias("earliest"),
                 F.max(clock).alias("latest")))


@query("etl_10_late_flag", sql("ord", """
SELECT order_key, is_late, CASE WHEN is_delivery THEN greatest(actual_min - 45, 0) END AS minutes_over
FROM ord"""))
def etl_10(s):
    return s.order_heads.select(
        "order_key", is_late("actual_min", "promised_min").alias("is_late"),
        F.when(F.col("is_delivery"), late_minutes_over("actual_min", "promised_min"))
        .alias("minutes_over"))


# ------------------------------------------------------------------- marts

KPI_COLS = """date_key, year, month, month_name, month_name_de, iso_week, day_of_week, day_name,
  day_name_de, is_weekend, is_public_holiday, is_school_holiday, temp_mean_c, precipitation_mm,
  is_rainy, orders, delivery_orders, pickup_orders, cancelled_orders, items_sold, gross_revenue,
  discount_total, delivery_fee_total, commission_total, net_revenue, food_cost, labour_cost,
  waste_eur, packaging_cost, payment_fees, fixed_cost, royalty_cost, kitchen_hours, driver_hours,
  contribution_margin, contribution_margin_pct, operating_profit, operating_margin_pct,
  breakeven_load_pct, avg_order_value, food_cost_pct, labour_cost_pct, delivery_share_pct,
  avg_delivery_min, late_rate_pct, orders_per_kitchen_hour, orders_per_driver_hour"""


@query("mart_1_kpi_daily", sql("kpi", f"SELECT {day('full_date')}, {KPI_COLS} FROM kpi"))
def mart_1(s):
    return s.kpi


@query("mart_2_kpi_zone", sql("ord zone", f"""
SELECT z.zone_key, plz, district_name, plz || ' ' || district_name AS zone_label,
  CAST(km AS DOUBLE) AS distance_km, count(*) AS orders, {eur('sum(gross_c)')} AS gross_revenue,
  {eur('sum(net_c)')} AS net_revenue, {eur('sum(net_c - food_c)')} AS gross_margin,
  {ratio('sum(gross_c)', 'count(*) * 100')} AS avg_order_value,
  {ratio('sum(actual_min)', 'count(actual_min)', 1, 1)} AS avg_delivery_min,
  {ratio('count(*) FILTER (WHERE is_late)', 'count(*)', 100, 1)} AS late_rate_pct,
  {ratio('sum(net_c - food_c)', 'sum(actual_min) * 100', 1, 3)} AS margin_per_drive_minute
FROM ord o JOIN zone z USING (zone_key) WHERE is_delivery GROUP BY z.zone_key, plz, district_name, km"""))
def mart_2(s):
    return marts.kpi_zone(s.orders, s.zones)


KPI_ITEM = f"""
SELECT i.item_key, item_name, category, coalesce(size_name, '-') AS size_name,
  {eur('price_c')} AS unit_price, CAST(sum(quantity) AS BIGINT) AS units_sold,
  {eur('sum(rev_c)')} AS revenue, {eur('sum(rev_c - l.cost_c)')} AS margin,
  {ratio('sum(rev_c - l.cost_c)', 'sum(rev_c)', 100, 1)} AS margin_pct,
  count(DISTINCT order_key) AS orders_containing
FROM line l JOIN item i USING (item_key)
GROUP BY i.item_key, item_name, category, size_name, price_c"""


@query("mart_3_kpi_item", sql("line item", KPI_ITEM))
def mart_3(s):
    return marts.kpi_item(s.lines, s.items)


KPI_CHANNEL = f"""
SELECT o.date_key, full_date, c.channel_key, channel_name, is_aggregator, count(*) AS orders,
  {eur('sum(gross_c)')} AS gross_revenue, {eur('sum(comm_c)')} AS commission,
  {eur('sum(net_c)')} AS net_revenue, {eur('sum(net_c - food_c)')} AS gross_margin,
  {ratio('sum(gross_c)', 'count(*) * 100')} AS avg_order_value, sum(gross_c) AS gross_c,
  sum(comm_c) AS comm_c, sum(net_c - food_c) AS margin_c
FROM ord o JOIN channel c USING (channel_key)
GROUP BY o.date_key, full_date, c.channel_key, channel_name, is_aggregator"""


@query("mart_4_kpi_channel_daily", sql("ord channel", f"""
SELECT * EXCLUDE (gross_c, comm_c, margin_c) REPLACE (CAST(full_date AS VARCHAR) AS full_date)
FROM ({KPI_CHANNEL})"""))
def mart_4(s):
    return marts.kpi_channel_daily(s.orders, s.channels, s.calendar)


@query("mart_5_customer_base", sql("cust ord", f"""
SELECT c.customer_key, customer_code, c.zone_key, signup_channel,
  {day('min(o.full_date)', 'first_order_date')}, count(o.order_key) AS total_orders,
  {eur('sum(gross_c)')} AS total_spend, {ratio('sum(gross_c)', 'count(o.order_key) * 100')} AS avg_order_value,
  {day('max(o.full_date)', 'last_order_date')}
FROM cust c LEFT JOIN ord o USING (customer_key)
GROUP BY c.customer_key, customer_code, c.zone_key, signup_channel"""))
def mart_5(s):
    customers = etl.with_first_order(s.customers, s.order_heads, s.plain_calendar)
    return marts.customer_base(customers, s.orders, s.plain_calendar)


@query("mart_6_daily_actuals", sql("actuals", f"""
SELECT * REPLACE (CAST(business_date AS VARCHAR) AS business_date) FROM actuals"""))
def mart_6(s):
    return marts.daily_actuals(s.kpi, s.entries)


@query("mart_7_cost_assumptions", sql("assume ord", f"""
SELECT cost_item, cost_type, coalesce(round(monthly_eur * 12 / 365, 2), 0.0) AS fixed_per_day,
  CASE WHEN pct_of_revenue IS NOT NULL
    THEN round((SELECT sum(net_c) FROM ord) / 100.0 * pct_of_revenue, 0) END AS rate_of_net
FROM assume"""))
def mart_7(s):
    """Fixed and variable cost lines, sized against the net revenue."""
    net = s.orders.agg(F.sum("net_revenue").alias("n")).scalar()
    return s.assumptions.select(
        "cost_item", "cost_type",
        F.coalesce(F.round(F.col("monthly_eur") * 12 / 365, 2), F.lit(0)).alias("fixed_per_day"),
        F.round(net * F.col("pct_of_revenue"), 0).alias("rate_of_net"))
