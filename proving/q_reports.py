"""Reporting queries on the marts."""

from pyspark.sql import functions as F

from martloom.operators import quality
from martloom.plans import marts, reports

from .oracle_base import day, eur, ratio, register, sql
from .q_marts import KPI_CHANNEL, KPI_ITEM
from .registry import query

register("kitem", KPI_ITEM, ["line", "item"])
register("kchan", KPI_CHANNEL, ["ord", "channel"])


@query("rep_1_headline", sql("kpi", f"""
SELECT count(*) AS days, {eur('sum(gross_c)')} AS revenue, CAST(sum(orders) AS BIGINT) AS orders,
  {ratio('sum(gross_c)', 'greatest(sum(orders), 1) * 100')} AS avg_order_value,
  {eur('sum(profit_c)')} AS operating_profit,
  {ratio('sum(profit_c)', 'greatest(sum(net_c), 100)', 100, 1)} AS operating_margin_pct
FROM kpi WHERE full_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""))
def rep_1(s):
    return reports.headline(s.kpi, "1996-01-01", "1999-12-31")


@query("rep_2_revenue_trend", sql("kpi", f"""
SELECT {day('full_date')}, gross_revenue, CASE WHEN count(*) OVER w = 7
  THEN round(avg(gross_c) OVER w / 100, 4) END AS avg_7_rows
FROM kpi WINDOW w AS (ORDER BY full_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def rep_2(s):
    t = reports.revenue_trend(s.kpi)
    return t.withColumn("avg_7_rows", F.round(F.col("avg_7_rows").cast("double"), 4))


@query("rep_3_weekday_profile", sql("kpi", """
SELECT day_of_week, day_name, round(avg(orders), 6) AS avg_orders FROM kpi GROUP BY ALL ORDER BY 1"""))
def rep_3(s):
    return reports.weekday_profile(s.kpi).withColumn("avg_orders", F.round("avg_orders", 6))


@query("rep_4_rain_split", sql("kpi", """
SELECT CASE WHEN is_rainy THEN 'Rainy' ELSE 'Dry' END AS weather, round(avg(orders), 6) AS avg_orders
FROM kpi WHERE is_rainy IS NOT NULL GROUP BY 1"""))
def rep_4(s):
    return reports.rain_split(s.kpi).withColumn("avg_orders", F.round("avg_orders", 6))


@query("rep_5_pnl_lines", sql("kpi", f"""
SELECT line, {eur('c')} AS eur, {ratio('c', 'n', 100, 1)} AS pct_of_net_revenue FROM (
  SELECT sum(net_c) AS n, unnest(['Net revenue', 'Food cost', 'Packaging', 'Waste', 'Labour',
      'Payment fees', 'Fixed costs', 'Franchise fees', '= Operating profit']) AS line,
    unnest([sum(net_c), -sum(food_c), -sum(pack_c), -sum(waste_c), -sum(labour_c), -sum(pay_c),
      -sum(fixed_c), -sum(royal_c), sum(net_c) - sum(food_c) - sum(pack_c) - sum(waste_c)
      - sum(labour_c) - sum(pay_c) - sum(fixed_c) - sum(royal_c)]) AS c FROM kpi)"""))
def rep_5(s):
    return reports.pnl_lines(s.kpi)


@query("rep_6_zone_table", sql("ord zone", f"""
SELECT plz, district_name, CAST(km AS DOUBLE) AS distance_km, count(*) AS orders,
  {ratio('sum(gross_c)', 'count(*) * 100')} AS avg_order_value,
  {ratio('sum(actual_min)', 'count(actual_min)', 1, 1)} AS avg_delivery_min,
  {ratio('count(*) FILTER (WHERE is_late)', 'count(*)', 100, 1)} AS late_rate_pct,
  {ratio('sum(net_c - food_c)', 'sum(actual_min) * 100', 1, 3)} AS margin_per_drive_minute
FROM ord o JOIN zone z USING (zone_key) WHERE is_delivery GROUP BY plz, district_name, km
ORDER BY km, plz"""))
def rep_6(s):
    return reports.zone_table(marts.kpi_zone(s.orders, s.zones))


@query("rep_8_item_ranking", sql("kitem", """
SELECT * EXCLUDE (orders_containing) FROM kitem ORDER BY revenue DESC, item_key"""))
def rep_8(s):
    return reports.item_ranking(marts.kpi_item(s.lines, s.items))


@query("rep_8_category_revenue", sql("line item", f"""
SELECT category, {eur('sum(rev_c)')} AS revenue FROM line JOIN item USING (item_key) GROUP BY 1"""))
def rep_8b(s):
    return reports.category_revenue(marts.kpi_item(s.lines, s.items))


@query("rep_9_daily_log", sql("actuals", f"""
SELECT {day('business_date')}, total_orders, gross_revenue, avg_order_value, delivery_orders,
  pickup_orders, staff_hours, source FROM actuals ORDER BY actuals.business_date DESC LIMIT 30"""))
def rep_9(s):
    return reports.daily_log(marts.daily_actuals(s.kpi, s.entries))


@query("rep_9_source_counts", sql("actuals", "SELECT source, count(*) AS n FROM actuals GROUP BY 1"))
def rep_9b(s):
    return reports.source_counts(marts.daily_actuals(s.kpi, s.entries))


@query("rep_10_week_on_week", sql("kpi", f"""
SELECT {day('a.full_date', 'full_date')}, a.gross_revenue, b.gross_revenue AS revenue_last_week,
  {ratio('a.gross_c - b.gross_c', 'b.gross_c', 100, 1)} AS wow_pct
FROM kpi a LEFT JOIN kpi b ON b.full_date = a.full_date - 7"""))
def rep_10(s):
    return reports.week_on_week(s.kpi)


@query("rep_11_trailing_and_ytd", sql("kpi", f"""
SELECT {day('full_date')}, gross_revenue, round(avg(gross_c) OVER (ORDER BY full_date RANGE BETWEEN
    INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) / 100, 4) AS avg_7_days,
  {eur('sum(gross_c) OVER (PARTITION BY year ORDER BY full_date)')} AS revenue_ytd FROM kpi"""))
def rep_11(s):
    t = reports.trailing_and_ytd(s.kpi)
    return t.withColumn("avg_7_days", F.round(F.col("avg_7_days").cast("double"), 4))


@query("rep_12_delivery_headline", sql("ord", f"""
SELECT count(*) FILTER (WHERE is_delivery) AS deliveries, count(*) FILTER (WHERE is_late) AS late_orders,
  {ratio('sum(actual_min)', 'count(actual_min)', 1, 2)} AS avg_delivery_min,
  {ratio('count(*) FILTER (WHERE is_late)', 'count(*) FILTER (WHERE is_delivery)', 1, 4)} AS late_rate
FROM ord"""))
def rep_12(s):
    return reports.delivery_headline(s.orders)


@query("rep_13_channel_economics", sql("kchan", f"""
SELECT channel_key, channel_name, is_aggregator, CAST(sum(orders) AS BIGINT) AS orders,
  {eur('sum(gross_c)')} AS gross_revenue, {eur('sum(comm_c)')} AS commission,
  {eur('sum(margin_c)')} AS gross_margin,
  {ratio('sum(gross_c)', '(SELECT sum(gross_c) FROM kchan)', 100, 1)} AS revenue_share_pct,
  {ratio('sum(margin_c)', 'sum(orders) * 100')} AS margin_per_order
FROM kchan GROUP BY channel_key, channel_name, is_aggregator"""))
def rep_13(s):
    return reports.channel_economics(marts.kpi_channel_daily(s.orders, s.channels,
                                                             s.plain_calendar))


@query("rep_13_aggregator_share", sql("kchan", f"""
SELECT {eur('sum(comm_c)')} AS commission_paid,
  {ratio('sum(gross_c) FILTER (WHERE is_aggregator)', 'sum(gross_c)', 100, 1)} AS aggregator_share_pct
FROM kchan"""))
def rep_13b(s):
    return reports.aggregator_share(marts.kpi_channel_daily(s.orders, s.channels,
                                                            s.plain_calendar))


@query("rep_14_entry_summary", sql("entry", f"""
SELECT {day('a.business_date', 'business_date')}, a.total_orders, {eur('a.gross_c')} AS gross_revenue,
  {ratio('a.total_orders - b.total_orders', 'b.total_orders', 100, 0)} AS orders_change_pct,
  {ratio('a.gross_c - b.gross_c', 'b.gross_c', 100, 0)} AS revenue_change_pct,
  {ratio('a.gross_c', 'a.total_orders * 100')} AS avg_order_value,
  {ratio('a.delivery_orders', 'a.total_orders', 100, 0)} AS delivery_share_pct,
  {ratio('(a.staff_h * 1550 + a.driver_h * 1500 + 50) // 100', 'a.gross_c', 100, 0)} AS labour_pct,
  {eur('a.waste_c')} AS waste_eur
FROM entry a LEFT JOIN entry b ON b.business_date = a.business_date - 7"""))
def rep_14(s):
    return reports.entry_summary(s.entries)


@query("rep_15_menu_quadrant", sql("kitem", """
SELECT item_key, item_name, units_sold, margin_pct, CASE
    WHEN units_sold >= mu AND margin_pct >= mm THEN 'star' WHEN units_sold >= mu THEN 'workhorse'
    WHEN margin_pct >= mm THEN 'puzzle' ELSE 'dead weight' END AS quadrant
FROM kitem, (SELECT median(units_sold) AS mu, median(margin_pct) AS mm FROM kitem)"""))
def rep_15(s):
    return reports.menu_quadrant(marts.kpi_item(s.lines, s.items))


def effect_days(s):
    per = s.order_heads.groupBy("date_key").agg(F.count(F.lit(1)).alias("orders"))
    return quality.effect_frame(per.join(s.calendar, "date_key"))


@query("rep_16_demand_drivers")
def rep_16(s):
    return quality.demand_drivers(effect_days(s))
