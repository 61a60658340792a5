"""Customers, baskets, anomalies, delivery, forecast, quality, streams."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom import streaming
from martloom.fixed_values import PLAUSIBLE
from martloom.functions import date_of_key, half_even
from martloom.operators import anomaly, basket, customers, delivery, forecast, quality
from martloom.operators.stable import scratch_path, stable
from martloom.plans import marts, reports

from .oracle_base import day, eur, ratio, register, sql
from .q_reports import effect_days
from .registry import query
from .solving import register_forecast, register_predictions

# --------------------------------------------------------------- customers


def dated_orders(s):
    return s.orders.withColumn(
        "full_date", date_of_key("date_key"))


register("rfm0", """
  SELECT *, last - first_day AS tenure_days, last - last_day AS recency_days,
    row_number() OVER (ORDER BY frequency, customer_key) AS frn,
    row_number() OVER (ORDER BY monetary_c, customer_key) AS mrn, count(*) OVER () AS cn
  FROM (SELECT customer_key, min(full_date) AS first_day, max(full_date) AS last_day,
          count(*) AS frequency, CAST(sum(gross_c) AS BIGINT) AS monetary_c
        FROM ord GROUP BY customer_key), (SELECT max(full_date) AS last FROM ord)""", ["ord"])
register("rfm1", """
  SELECT *, CAST(5 - ((recency_days > round(q[1], 9))::INT + (recency_days > round(q[2], 9))::INT
      + (recency_days > round(q[3], 9))::INT + (recency_days > round(q[4], 9))::INT) AS INTEGER) AS r_score,
    CAST(greatest(1, (5 * (frn - 1) + cn - 2) // (cn - 1)) AS INTEGER) AS f_score,
    CAST(greatest(1, (5 * (mrn - 1) + cn - 2) // (cn - 1)) AS INTEGER) AS m_score
  FROM rfm0, (SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS q FROM rfm0)""", ["rfm0"])
register("rfm", """
  SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champion'
      WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
      WHEN r_score >= 4 AND f_score <= 2 THEN 'New / Promising'
      WHEN r_score <= 2 AND f_score >= 4 THEN 'At risk - was valuable'
      WHEN r_score <= 2 AND f_score >= 2 THEN 'Slipping away'
      WHEN r_score <= 2 THEN 'Lost' ELSE 'Occasional' END AS segment FROM rfm1""", ["rfm1"])


@query("cus_1_rfm", sql("rfm", f"""
SELECT customer_key, {day('first_day', 'first_order')}, {day('last_day', 'last_order')},
  CAST(recency_days AS INTEGER) AS recency_days, CAST(tenure_days AS INTEGER) AS tenure_days,
  frequency, {eur('monetary_c')} AS monetary,
  round_even({eur('monetary_c')} / frequency, 2) AS avg_order_value, r_score, f_score, m_score, r_score * 100 + f_score * 10 + m_score AS rfm_score, segment FROM rfm"""))
def cus_1(s):
    return customers.rfm(dated_orders(s))


@query("cus_2_segments", sql("rfm", "SELECT segment, count(*) AS customers FROM rfm GROUP BY 1"))
def cus_2(s):
    return customers.rfm(dated_orders(s)).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"))


@query("cus_3_segment_summary", sql("rfm", f"""
SELECT segment, count(*) AS customers, {eur('sum(monetary_c)')} AS revenue,
  round(avg(frequency), 4) AS avg_orders,
  {ratio('sum(monetary_c)', '(SELECT sum(monetary_c) FROM rfm)', 100, 1)} AS revenue_share_pct
FROM rfm GROUP BY segment"""))
def cus_3(s):
    return customers.segment_summary(customers.rfm(dated_orders(s)))


register("churn", """
  SELECT customer_key, count(*) AS frequency, CAST(sum(gross_c) AS BIGINT) AS monetary_c,
    CAST(cut - max(full_date) AS INTEGER) AS recency_days, CAST(cut - min(full_date) AS INTEGER) AS tenure_days,
    avg(CAST(is_delivery AS INTEGER)) AS delivery_share,
    CASE WHEN customer_key IN (SELECT customer_key FROM ord WHERE full_date > cut) THEN 1 ELSE 0 END AS returned
  FROM ord, (SELECT max(full_date) - 60 AS cut FROM ord) WHERE full_date <= cut GROUP BY customer_key, cut""",
         ["ord"])


@query("cus_4_churn_features", sql("churn", f"""
SELECT customer_key, frequency, {eur('monetary_c')} AS monetary,
  round_even({eur('monetary_c')} / frequency, 4) AS avg_order_value, recency_days, tenure_days,
  round(frequency / greatest(tenure_days / 30.0, 1), 6) AS orders_per_month,
  round(delivery_share, 6) AS delivery_share, returned FROM churn"""))
def cus_4(s):
    f = customers.churn_features(dated_orders(s))
    return f.withColumns({"avg_order_value": half_even("avg_order_value", 4),
                          "orders_per_month": F.round("orders_per_month", 6),
                          "delivery_share": F.round("delivery_share", 6)})


@query("cus_5_churn_model")
def cus_5(s):
    """Scores from the default 200 boosting rounds."""
    scored, auc = customers.churn_model(customers.churn_features(dated_orders(s)))
    return scored.withColumn("auc", F.lit(auc))


def rule_scored(s):
    """Churn table on a score both engines can repeat: recency / 400, capped."""
    f = customers.churn_features(dated_orders(s))
    p = F.least(F.lit(1.0), F.col("recency_days") / F.lit(400.0))
    return customers.churn_bands(f.withColumn("churn_probability", p))


register("banded", """
  SELECT *, CASE WHEN p <= 0.33 THEN 'Low' WHEN p <= 0.66 THEN 'Medium' ELSE 'High' END AS risk_band
  FROM (SELECT *, round_even(least(1.0, recency_days / 400.0), 4) AS p FROM churn)""", ["churn"])


@query("cus_6_winback_list", sql("banded", f"""
SELECT customer_key, frequency, {eur('monetary_c')} AS monetary,
  round_even({eur('monetary_c')} / frequency, 2) AS avg_order_value, recency_days, p AS churn_probability
FROM banded WHERE risk_band = 'High' ORDER BY monetary_c DESC, customer_key LIMIT 50"""))
def cus_6(s):
    return customers.winback_list(rule_scored(s))


@query("cus_7_band_value", sql("banded", f"""
SELECT risk_band, count(*) AS customers, {eur('sum(monetary_c)')} AS historic_value
FROM banded GROUP BY risk_band"""))
def cus_7(s):
    return customers.band_value(rule_scored(s))


# ----------------------------------------------------------------- baskets

register("bask", """
  SELECT DISTINCT order_key, item_name FROM line JOIN item USING (item_key)""", ["line", "item"])
register("supp", """
  SELECT item_name, count(*) AS orders, (SELECT count(DISTINCT order_key) FROM bask) AS total
  FROM bask GROUP BY item_name""", ["bask"])


@query("bsk_1_baskets", sql("bask", "SELECT order_key, item_name FROM bask"))
def bsk_1(s):
    return basket.baskets(s.lines, s.items)


@query("bsk_2_item_support", sql("supp", """
SELECT item_name, orders, total, round(orders / total::DOUBLE, 6) AS support FROM supp
WHERE orders / total::DOUBLE >= 0.01"""))
def bsk_2(s):
    b = stable(basket.baskets(s.lines, s.items), "baskets")
    return basket.item_support(b, 0.01).withColumn("support", F.round("support", 6))


@query("bsk_3_pair_rules", sql("bask supp", """
SELECT row_number() OVER (ORDER BY lift DESC, item_a, item_b) AS rule_key, item_a, item_b, support,
  confidence, lift
FROM (SELECT item_a, item_b, round_even(n / total::DOUBLE, 4) AS support,
        round_even(n / na::DOUBLE, 4) AS confidence, round_even((n * total) / (na * nb)::DOUBLE, 3) AS lift
      FROM (SELECT x.item_name AS item_a, y.item_name AS item_b, count(*) AS n
            FROM bask x JOIN bask y ON x.order_key = y.order_key AND x.item_name <> y.item_name
            GROUP BY 1, 2) p
      JOIN (SELECT item_name AS item_a, orders AS na, total FROM supp) a USING (item_a)
      JOIN (SELECT item_name AS item_b, orders AS nb FROM supp) b USING (item_b)
      WHERE n / total::DOUBLE >= 0.003 AND (n * total) / (na * nb)::DOUBLE >= 1.05
        AND na / total::DOUBLE >= 0.003 AND nb / total::DOUBLE >= 0.003)
ORDER BY rule_key LIMIT 200"""))
def bsk_3(s):
    b = stable(basket.baskets(s.lines, s.items), "baskets")
    return basket.pair_rules(b, min_support=0.003, min_lift=1.05)


TRIPLES = 0.00037


@query("bsk_4_itemsets", sql("bask supp", """
SELECT items, orders FROM (
  WITH RECURSIVE sub AS (
    SELECT order_key, item_name AS last, item_name AS items FROM bask
    UNION ALL
    SELECT s.order_key, b.item_name, s.items || '+' || b.item_name
    FROM sub s JOIN bask b ON b.order_key = s.order_key AND b.item_name > s.last)
  SELECT items, count(*) AS orders FROM sub GROUP BY items)
WHERE orders / (SELECT max(total) FROM supp)::DOUBLE >= SUPPORT""".replace("SUPPORT", str(TRIPLES))))
def bsk_4(s):
    """Sets of any size, at a support that triples reach."""
    b = stable(basket.baskets(s.lines, s.items), "baskets")
    return basket.itemsets_fpgrowth(b, TRIPLES).select(
        F.concat_ws("+", "items").alias("items"), "orders")


# --------------------------------------------------------------- anomalies

register("met", """
  SELECT full_date, u, day_name, day_of_week, is_rainy, is_public_holiday, is_school_holiday,
    orders::DOUBLE AS orders, coalesce(disc_c / nullif(gross_c, 0)::DOUBLE * 100, 0) AS discount_rate,
    coalesce(waste_c / nullif(gross_c, 0)::DOUBLE * 100, 0) AS waste_pct, late_rate_pct FROM kpi""",
         ["kpi"])


@query("ano_1_metrics", sql("met", f"""
SELECT {day('full_date')}, round(discount_rate, 6) AS discount_rate, round(waste_pct, 6) AS waste_pct,
  late_rate_pct, is_rainy::INT AS is_rainy_i, is_public_holiday::INT AS ph, is_school_holiday::INT AS sh
FROM met"""))
def ano_1(s):
    return anomaly.anomaly_metrics(s.kpi).select(
        "full_date", F.round("discount_rate", 6).alias("discount_rate"),
        F.round("waste_pct", 6).alias("waste_pct"), "late_rate_pct", "is_rainy_i", "ph", "sh")


@query("ano_2_robust_residuals")
def ano_2(s):
    rows = anomaly.metric_rows(anomaly.anomaly_metrics(stable(s.kpi, "kpi")))
    return anomaly.robust_residuals(rows).select("full_date", "metric", "value", "resid")


def simple_residuals(s):
    """Residual = metric minus its weekday median."""
    kpi = anomaly.anomaly_metrics(stable(s.kpi, "kpi"))
    rows = anomaly.metric_rows(kpi)
    med = rows.groupBy("metric", "day_of_week").agg(F.expr("percentile(value, 0.5)").alias("m"))
    return rows.join(med, ["metric", "day_of_week"]).withColumn(
        "resid", F.col("value") - F.col("m")).drop("m")


register("res", """
  SELECT *, value - median(value) OVER (PARTITION BY metric, day_of_week) AS resid FROM (
    UNPIVOT (SELECT full_date, day_name, day_of_week, orders, discount_rate, waste_pct, late_rate_pct FROM met)
    ON orders, discount_rate, waste_pct, late_rate_pct INTO NAME metric VALUE value)""", ["met"])
register("zed", """
  SELECT r.*, (resid - med) / (CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd ELSE 1 END) AS z
  FROM res r JOIN (
    SELECT metric, day_of_week, max(med) AS med, median(abs(resid - med)) AS mad, stddev_samp(resid) AS sd
    FROM (SELECT *, median(resid) OVER (PARTITION BY metric, day_of_week) AS med FROM res)
    GROUP BY metric, day_of_week) USING (metric, day_of_week)""", ["res"])


@query("ano_3_group_mad_z", sql("zed", f"""
SELECT {day('full_date')}, metric, CASE WHEN round(z, 5) = 0 THEN 0 ELSE round(z, 5) END AS z
FROM zed"""))
def ano_3(s):
    z = anomaly.group_mad_z(simple_residuals(s), "resid", ["metric", "day_of_week"])
    return z.select("full_date", "metric", F.round("z", 5).alias("z"))


@query("ano_4_flag_anomalies", sql("zed", f"""
SELECT row_number() OVER (ORDER BY full_date, metric) AS anomaly_key, {day('full_date')}, day_name, metric,
  CASE metric WHEN 'orders' THEN 'demand' WHEN 'discount_rate' THEN 'margin leakage'
    WHEN 'waste_pct' THEN 'waste' ELSE 'delivery' END AS category,
  CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM zed WHERE abs(z) > 3.0"""))
def ano_4(s):
    z = anomaly.group_mad_z(simple_residuals(s), "resid", ["metric", "day_of_week"])
    return anomaly.flag_anomalies(z).drop("actual", "z_score")


@query("ano_5_recall_windows")
def ano_5(s):
    """Full model flags against the weeks around every tenth holiday."""
    flags = anomaly.anomaly_daily(stable(s.kpi, "kpi"))
    windows = s.holidays.filter(F.unix_date("holiday_date") % 300 == 0).select(
        F.date_format("holiday_date", "yyyy-MM-dd").alias("name"),
        F.date_sub("holiday_date", 3).alias("start"), F.date_add("holiday_date", 3).alias("end"))
    return anomaly.recall_windows(flags, windows)


# ---------------------------------------------------------------- delivery


def trips(s):
    daily = s.order_heads.groupBy("date_key").agg(F.count(F.lit(1)).alias("orders"))
    return delivery.delivery_frame(s.orders, s.zones, s.calendar, daily)


register("trip", """
  SELECT order_key, o.zone_key, plz, district_name, km, actual_min, is_late, item_qty, day_of_week,
    CASE WHEN c.is_rainy THEN 1 ELSE 0 END AS is_rainy, temp_mean_c, precipitation_mm,
    4 + km * 2 AS drive, n.orders_that_day,
    CASE daypart WHEN 'Nachmittag' THEN 1 WHEN 'Abend' THEN 2 WHEN 'Spaet' THEN 3 ELSE 0 END AS daypart_code
  FROM ord o JOIN zone z USING (zone_key) JOIN cal c ON c.date_key = o.date_key
  JOIN (SELECT date_key, count(*) AS orders_that_day FROM head GROUP BY 1) n ON n.date_key = o.date_key
  WHERE is_delivery AND actual_min IS NOT NULL""", ["ord", "zone", "cal", "head"])


@query("del_1_delivery_frame", sql("trip", """
SELECT order_key, plz, CAST(km AS DOUBLE) AS distance_km, CAST(drive AS DOUBLE) AS base_drive_min,
  orders_that_day, daypart_code, is_rainy, precipitation_mm, temp_mean_c, day_of_week, item_qty, actual_min
FROM trip"""))
def del_1(s):
    return trips(s).select("order_key", "plz", "distance_km", "base_drive_min",
                           "orders_that_day", "daypart_code", "is_rainy", "precipitation_mm",
                           "temp_mean_c", "day_of_week", "item_qty", "actual_min")


@query("del_2_promise_times", sql("trip", """
SELECT zone_key, plz, district_name, CAST(km AS DOUBLE) AS distance_km, count(*) AS orders,
  round_even(avg(actual_min), 1) AS avg_min,
  CAST(round_even(round(quantile_cont(actual_min, 0.8), 9), 0) AS INTEGER) AS p80_min,
  CAST(round_even(round(quantile_cont(actual_min, 0.95), 9), 0) AS INTEGER) AS p95_min,
  round_even(avg(is_late::INT) * 100, 1) AS current_late_pct,
  CAST(ceil(round(quantile_cont(actual_min, 0.8), 9) / 5) * 5 AS INTEGER) AS recommended_promise_min,
  45 AS current_promise_min
FROM trip GROUP BY zone_key, plz, district_name, km"""))
def del_2(s):
    return delivery.promise_times(trips(s))


@query("del_3_delivery_time_model")
def del_3(s):
    """Scores from the default 400 trees."""
    return delivery.delivery_time_model(trips(s))[2]


@query("del_4_delivery_factors")
def del_4(s):
    model, test, _ = delivery.delivery_time_model(trips(s))
    return delivery.delivery_factors(model, test)


# ---------------------------------------------------------------- forecast


def kpi_full(s):
    return stable(s.kpi, "kpi")


@query("fct_1_forecast_frame", sql("kpi", f"""
SELECT {day('full_date', 'ds')}, orders AS y, precipitation_mm, temp_mean_c, is_rainy::INT AS is_rainy,
  is_public_holiday::INT AS is_public_holiday, is_school_holiday::INT AS is_school_holiday FROM kpi"""))
def fct_1(s):
    return forecast.forecast_frame(s.kpi)


def future(s):
    """Two weeks that start three weeks before the history ends, so that the
    calendar and weather tables cover them; every sixth day has no weather."""
    last = s.order_heads.select(date_of_key("date_key")
                                .alias("ds")).agg(F.date_sub(F.max("ds"), 21).alias("ds"))
    weather = s.weather.filter(F.unix_date("full_date") % 6 != 0)
    return forecast.future_frame(last, 14, weather, s.holidays, s.spans)


@query("fct_2_future_frame", sql("weather school head", f"""
SELECT {day('ds')}, coalesce(last_value(mm IGNORE NULLS) OVER a, first_value(mm IGNORE NULLS) OVER b) AS precipitation_mm,
  coalesce(last_value(t IGNORE NULLS) OVER a, first_value(t IGNORE NULLS) OVER b) AS temp_mean_c,
  coalesce(mm > 2.0, FALSE)::INT AS is_rainy, (u % 30 = 0)::INT AS is_public_holiday,
  (ds IN (SELECT full_date FROM school))::INT AS is_school_holiday
FROM (SELECT full_date AS ds, u, CASE WHEN u % 6 <> 0 THEN mm_raw / 100.0::DOUBLE END AS mm,
        CASE WHEN u % 6 <> 0 THEN temp_raw END AS t
      FROM weather, (SELECT max(full_date) - 21 AS last FROM head)
      WHERE full_date BETWEEN last + 1 AND last + 14)
WINDOW a AS (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def fct_2(s):
    return future(s)


register_forecast("whole", "SELECT * FROM kpi", ["kpi"])
register_forecast("early", "SELECT * EXCLUDE back FROM (SELECT *, row_number() OVER (ORDER BY full_date DESC) AS back "
                  "FROM kpi) WHERE back > 28", ["kpi"])
register("late_days", """
  SELECT full_date AS ds, orders AS y, precipitation_mm AS mm, temp_mean_c AS tc, coalesce(is_rainy::INT, 0) AS rain,
    coalesce(is_public_holiday::INT, 0) AS ph, coalesce(is_school_holiday::INT, 0) AS sh,
    lag(orders, 7) OVER (ORDER BY full_date) AS earlier, row_number() OVER (ORDER BY full_date DESC) AS back
  FROM kpi""", ["kpi"])
register_predictions("tested", "early", "SELECT * FROM late_days WHERE back <= 28", ["late_days"])


@query("fct_3_fit_forecast", sql("whole_fit whole_place", f"""
SELECT term, round(coefficient, 6) AS coefficient, round(sigma, 6) AS sigma, round(bend, 6) AS bend
FROM (SELECT unnest([{', '.join(repr(t) for t in forecast.TERMS)}, *[f'bend={{k}}' for k in range(1, 26)]]) AS term,
  unnest(beta) AS coefficient, sigma, bend FROM whole_fit)""".replace(
    "*[f'bend={k}' for k in range(1, 26)]", ", ".join(f"'bend={k}'" for k in range(1, 26)))))
def fct_3(s):
    """Every coefficient of the fit, slope changes included."""
    model = forecast.fit_forecast(forecast.forecast_frame(kpi_full(s)))
    names = F.array(*[F.lit(t) for t in (*forecast.TERMS, *[f"bend={k + 1}" for k in range(forecast.BENDS)])])
    return model.select(F.inline(F.arrays_zip(names.alias("term"), F.col("beta").alias("coefficient"))),
                        "sigma", "bend").select(
        "term", *[F.round(c, 6).alias(c) for c in ("coefficient", "sigma", "bend")])


@query("fct_4_backtest", sql("tested", """
SELECT count(*) AS days, round(avg(abs(yhat - y)), 6) AS mae, round(avg(abs(yhat - y) / y), 6) AS mape,
  round(avg((y BETWEEN yhat_lower AND yhat_upper)::INT), 6) AS covered, round(avg(abs(y - earlier)), 6) AS naive_mae,
  round(1 - avg(abs(yhat - y)) / avg(abs(y - earlier)), 6) AS improvement FROM tested"""))
def fct_4(s):
    skill = forecast.skill(stable(forecast.forecast_frame(s.kpi), "frame"))
    return skill.select("days", *[F.round(c, 6).alias(c) for c in
                                  ("mae", "mape", "covered", "naive_mae", "improvement")])


@query("fct_5_naive_baseline", sql("kpi", """
SELECT round(avg(abs(orders - earlier)), 6) AS naive_mae FROM (
  SELECT full_date, orders, lag(orders, 7) OVER (ORDER BY full_date) AS earlier,
    row_number() OVER (ORDER BY full_date DESC) AS back FROM kpi) WHERE back <= 28"""))
def fct_5(s):
    return forecast.naive_baseline(forecast.forecast_frame(s.kpi)).select(
        F.round("naive_mae", 6).alias("naive_mae"))


def before_horizon(s, kpi):
    """The history up to the day before the first day to be forecast."""
    first = future(s).agg(F.min("ds").alias("ds")).scalar()
    return kpi.filter(F.col("full_date") < first)


def forecasted(s):
    kpi = stable(before_horizon(s, kpi_full(s)), "history")
    model = forecast.fit_forecast(forecast.forecast_frame(kpi))
    return forecast.forecast_daily(model, future(s), kpi)


register("ahead", """
  SELECT ds, coalesce(last_value(mm IGNORE NULLS) OVER a, first_value(mm IGNORE NULLS) OVER b) AS mm,
    coalesce(last_value(t IGNORE NULLS) OVER a, first_value(t IGNORE NULLS) OVER b) AS tc,
    coalesce(mm > 2.0, FALSE)::INT AS rain, (u % 30 = 0)::INT AS ph, (ds IN (SELECT full_date FROM school))::INT AS sh
  FROM (SELECT full_date AS ds, u, CASE WHEN u % 6 <> 0 THEN mm_raw / 100.0::DOUBLE END AS mm,
          CASE WHEN u % 6 <> 0 THEN temp_raw END AS t
        FROM weather, (SELECT max(full_date) - 21 AS last FROM head)
        WHERE full_date BETWEEN last + 1 AND last + 14)
  WINDOW a AS (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    b AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", ["weather", "school", "head"])
register("history", "SELECT * FROM kpi WHERE full_date < (SELECT min(ds) FROM ahead)", ["kpi", "ahead"])
register_forecast("past", "SELECT * FROM history", ["history"])
register_predictions("coming", "past", "SELECT * FROM ahead", ["ahead"])
register("forecasted", """
  SELECT ds, round_even(yhat, 0)::BIGINT AS orders_forecast, round_even(greatest(yhat_lower, 0), 0)::BIGINT AS orders_lower,
    round_even(yhat_upper, 0)::BIGINT AS orders_upper, round_even(tc, 1) AS temp_mean_c,
    round_even(mm, 1) AS precipitation_mm, rain = 1 AS is_rainy, ph = 1 AS is_public_holiday,
    round_even(round_even(yhat, 0) * aov, 2) AS revenue_forecast
  FROM coming, (SELECT sum(gross_c) / 100.0::DOUBLE / sum(orders) AS aov FROM (
    SELECT *, row_number() OVER (ORDER BY full_date DESC) AS back FROM history) WHERE back <= 28)""",
         ["coming", "history"])


@query("fct_6_forecast_daily", sql("forecasted", f"""
SELECT {day('ds', 'full_date')}, dayname(ds) AS day_name, * EXCLUDE ds FROM forecasted"""))
def fct_6(s):
    return forecasted(s)


@query("rep_7_forecast_totals", sql("forecasted", """
SELECT CAST(sum(orders_forecast) AS BIGINT) AS orders, round(sum(revenue_forecast), 2) AS revenue FROM forecasted"""))
def rep_7(s):
    return reports.forecast_totals(forecasted(s))


# ----------------------------------------------------------------- quality

_ranges = ", ".join(f"('{m}', {float(lo)}::DOUBLE, {float(hi)}::DOUBLE)"
                    for m, (lo, hi) in PLAUSIBLE.items())


@query("dq_1_plausibility_gate", sql("ord shift", f"""
SELECT metric, round(value, 4) AS value, low, high,
  CASE WHEN coalesce(value BETWEEN low AND high, FALSE) THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT unnest(['aov_eur', 'orders_per_day', 'late_pct', 'delivery_min', 'food_cost_pct',
        'labour_cost_pct', 'operating_margin_pct']) AS metric,
    unnest([g / n / 100, n / days::DOUBLE, late / judged::DOUBLE * 100, mins / timed::DOUBLE,
      food / g::DOUBLE * 100, labour / net::DOUBLE * 100, (net - food - cost) / net::DOUBLE * 100]) AS value
  FROM (SELECT sum(gross_c) AS g, count(*) AS n, count(DISTINCT date_key) AS days, sum(food_c) AS food,
          sum(net_c) AS net, count(*) FILTER (WHERE is_late) AS late, count(is_late) AS judged,
          sum(actual_min) AS mins, count(actual_min) AS timed FROM ord),
       (SELECT sum(labour_c) AS labour, sum(labour_c + waste_c + pack_c + pay_c + fixed_c + royal_c) AS cost
        FROM shift))
JOIN (VALUES {_ranges}) AS r(metric, low, high) USING (metric)"""))
def dq_1(s):
    gate = quality.plausibility_gate(quality.plausibility_metrics(s.stored_orders, s.shifts))
    return gate.withColumn("value", F.round("value", 4))


@query("dq_2_effect_recovery")
def dq_2(s):
    return quality.effect_recovery(effect_days(s))


@query("dq_3_check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dq_3(s):
    return quality.check_unique(s.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_4_check_fk", """
SELECT o_orderkey AS fk, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
GROUP BY 1""")
def dq_4(s):
    """Orders without any line, found as dangling keys."""
    return quality.check_fk(s.raw("orders"), "o_orderkey", s.raw("lineitem"), "l_orderkey")


@query("dq_5_check_schema", """
SELECT 'l_discount' AS column_name, count(*) FILTER (WHERE l_discount <> floor(l_discount))
    || ' fractional values -> long' AS issue FROM lineitem
UNION ALL SELECT 'l_returnflag', 'string -> boolean'
UNION ALL SELECT 'l_tax', 'not in schema' UNION ALL SELECT 'l_comment', 'missing'""")
def dq_5(s):
    """Line items against a target that is wrong in four ways."""
    target = StructType.fromDDL(
        "l_orderkey long, l_quantity long, l_discount long, l_returnflag boolean, l_comment string")
    have = s.raw("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag",
                                    "l_tax")
    return quality.check_schema(have, target)


@query("dq_6_check_rules", sql("entry", """
SELECT unnest(['orders_not_negative', 'revenue_positive', 'staffed']) AS rule,
  unnest([count(*) FILTER (WHERE total_orders < 0), count(*) FILTER (WHERE NOT gross_c > 0),
    count(*) FILTER (WHERE NOT staff_h > 0)]) AS violations FROM entry"""))
def dq_6(s):
    return quality.check_rules(s.entries, {
        "orders_not_negative": F.col("total_orders") >= 0,
        "revenue_positive": F.col("gross_revenue") > 0, "staffed": F.col("staff_hours") > 0})


@query("dq_7_entry_rules", sql("entry", f"""
SELECT {day('business_date')}, NOT is_closed AND total_orders = 0 AND gross_c = 0 AS is_blocked,
  concat_ws(',', CASE WHEN delivery_orders + pickup_orders <> total_orders THEN 'split_mismatch' END,
    CASE WHEN total_orders > 0 AND NOT is_closed AND NOT gross_c BETWEEN 1200 * total_orders
      AND 4500 * total_orders THEN 'order_value_unusual' END,
    CASE WHEN total_orders > 0 AND gross_c = 0 THEN 'orders_without_revenue' END,
    CASE WHEN staff_h = 0 AND total_orders > 0 THEN 'orders_without_hours' END) AS warnings FROM entry"""))
def dq_7(s):
    return quality.entry_rules(s.entries).select(
        "business_date", "is_blocked", F.concat_ws(",", "warnings").alias("warnings"))


@query("dq_8_missing_days", sql("entry", """
SELECT strftime(DATE '2001-08-25' - i::INT, '%Y-%m-%d') AS business_date FROM range(1, 15) t(i)
WHERE DATE '2001-08-25' - i::INT NOT IN (SELECT business_date FROM entry)
  AND DATE '2001-08-25' - i::INT >= (SELECT min(business_date) FROM entry)"""))
def dq_8(s):
    return quality.missing_days(s.entries, "2001-08-25", 14)


@query("dq_9_freshness", sql("actuals", """
SELECT count(*) AS days, count(*) FILTER (WHERE source = 'history') AS from_history,
  count(*) FILTER (WHERE source = 'form') AS from_form,
  CAST(DATE '2001-08-20' - max(business_date) AS INTEGER) AS gap_days,
  DATE '2001-08-20' - max(business_date) > 1 AS is_stale FROM actuals"""))
def dq_9(s):
    return quality.freshness(marts.daily_actuals(s.kpi, s.entries), "2001-08-20")


@query("dq_10_reconcile", sql("ord line", f"""
SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS source, CAST(count(*) AS DOUBLE) AS loaded,
  TRUE AS matches FROM ord
UNION ALL SELECT 'gross_amount', {eur('(SELECT sum(rev_c) FROM line)')}, {eur('sum(gross_c)')},
  (SELECT sum(rev_c) FROM line) = sum(gross_c) FROM ord"""))
def dq_10(s):
    """Raw line revenue against the loaded order totals."""
    raw = s.order_heads.join(
        s.lines.groupBy("order_key").agg(F.sum("line_revenue").alias("gross_amount")),
        "order_key", "left")
    return quality.reconcile(raw, s.stored_orders, ["gross_amount"])


# ----------------------------------------------------------------- streams


@query("str_1_stream_entries", f"""
SELECT {day('business_date')}, event_id AS seq, total_orders, value AS gross_revenue
FROM (SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY ts DESC, event_id DESC) AS rn
      FROM (SELECT *, CAST(ts AS DATE) - 8202 AS business_date, user_id % 40 AS total_orders FROM events)
      WHERE NOT (total_orders = 0 AND round(value, 2) = 0)) WHERE rn = 1""")
def str_1(s):
    """Every event is one save of a day's entry; the newest save wins."""
    raw = s.raw("events")
    live = s.spark.readStream.schema(raw.schema).parquet(f"{s.dir}/events*.parquet")
    entries = s.as_entry_log(live).withColumns({
        "delivery_orders": F.col("total_orders"), "pickup_orders": F.lit(0),
        "is_closed": F.lit(False), "staff_hours": F.lit(1)})
    sink = scratch_path(s.spark, "entries")
    streaming.stream_entries(entries, sink, f"{sink}/checkpoint").awaitTermination()
    return streaming.current_entries(s.spark, sink).select(
        "business_date", "seq", "total_orders", "gross_revenue")


register("sday", """
  SELECT CAST(o_orderdate AS DATE) AS full_date, count(*) AS orders,
    count(*) FILTER (WHERE o_orderpriority[1] <> '5') AS delivery_orders,
    count(*) FILTER (WHERE o_orderpriority[1] = '5') AS pickup_orders,
    count(*) FILTER (WHERE o_orderkey % 67 = 0) AS cancelled_orders,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS gross_c,
    sum(15 + (o_orderkey * 37 + (o_custkey % 25 + 1) * 11) % 50)
      FILTER (WHERE o_orderpriority[1] <> '5')::BIGINT AS delivery_minutes,
    count(*) FILTER (WHERE o_orderpriority[1] <> '5') AS timed_orders,
    count(*) FILTER (WHERE o_orderpriority[1] <> '5'
      AND 15 + (o_orderkey * 37 + (o_custkey % 25 + 1) * 11) % 50 > 45) AS late_orders
  FROM orders GROUP BY 1""")


def live_orders(s, copies=1):
    """The orders as a stream of several files, one per batch, that are not in
    order of date; with ``copies``, each order comes again in a later file."""
    raw = s.raw("orders")
    inbox = scratch_path(s.spark, "inbox")
    for k in range(copies):
        raw.repartition(3, F.col("o_orderkey") % 7 + k).write.mode("append").parquet(inbox)
    live = s.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    return s.as_order_heads(live, keep=["o_totalprice"]).withColumn(
        "gross_amount", F.round(F.col("o_totalprice").cast("decimal(18,4)"), 2)).withColumn(
        "is_late", F.col("actual_min") > F.col("promised_min"))


@query("str_2_stream_kpi", sql("sday", f"""
SELECT {day('full_date')}, orders, delivery_orders, pickup_orders, cancelled_orders,
  {eur('gross_c')} AS gross_revenue, delivery_minutes, timed_orders, late_orders FROM sday"""))
def str_2(s):
    sink = scratch_path(s.spark, "kpi-stream")
    streaming.stream_kpi(live_orders(s), f"{sink}/log", f"{sink}/checkpoint").awaitTermination()
    return streaming.stream_kpi_result(s.spark, f"{sink}/log")


@query("str_3_stream_dedupe", sql("sday", f"""
SELECT {day('full_date')}, orders FROM sday"""))
def str_3(s):
    """Every order arrives twice, in different files; it is kept once."""
    sink = scratch_path(s.spark, "dedupe")
    streaming.stream_orders(live_orders(s, copies=2), f"{sink}/log", f"{sink}/checkpoint").awaitTermination()
    return streaming.distinct_orders(s.spark, f"{sink}/log").groupBy(
        F.to_date("order_ts").alias("full_date")).agg(F.count(F.lit(1)).alias("orders"))
