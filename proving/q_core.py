"""Sources, sinks, filters, joins, aggregates, windows, sorts, set operations."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom.functions import date_of_key, money, safe_ratio, value_map
from martloom.functions.labels import bin_fixed
from martloom.operators import aggregate as agg
from martloom.operators import combine, order, series
from martloom.operators.stable import scratch_path
from martloom.operators.quality import QualityError
from martloom.plans import load, marts
from martloom.sources import sinks, tables
from martloom.sources.shelf import Shelf

from .oracle_base import day, eur, ratio, register, sql

from .registry import query

# shared reductions used by several checks
register("dayn", f"""
  SELECT full_date, count(*) AS orders, count(*) FILTER (WHERE is_delivery) AS trips,
    CAST(sum(gross_c) AS BIGINT) AS gross_c FROM ord GROUP BY full_date""", ["ord"])


def day_orders(s):
    """Orders and revenue per day with the date on it."""
    return (marts.orders_by_day(s.orders)
            .join(s.plain_calendar.select("date_key", "full_date", "year"), "date_key")
            .select("full_date", "year", "orders",
                    F.col("delivery_orders").alias("trips"), "gross_revenue"))


# ------------------------------------------------------- sources and sinks


@query("src_1_read_table", """
SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def src_1(s):
    return tables.read_table(s.spark, s.dir, "core.nation", StructType.fromDDL(
        "n_nationkey int, n_name string, n_regionkey int"), ".parquet")


@query("src_4_daily_arrays", f"""
SELECT event_type, {day('d', 'time')}, n, round(v, 2) AS total
FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v
      FROM events GROUP BY ALL)""")
def src_4(s):
    """Payloads of parallel daily arrays, built from the events, read back."""
    daily = s.raw("events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("d", "n", "v")))
    payload = daily.groupBy("event_type").agg(ordered.alias("r")).select(
        "event_type", F.to_json(F.struct(F.struct(
            F.col("r.d").alias("time"), F.col("r.n").alias("n"),
            F.col("r.v").alias("v")).alias("daily"))).alias("payload"))
    return tables.parse_daily_arrays(
        payload, "payload", {"time": "date", "n": "bigint", "v": "double"},
        keep=["event_type"]).select("event_type", "time", "n", F.round("v", 2).alias("total"))


@query("src_6_lookup", sql("ord", f"""
SELECT order_key, date_key, {eur('gross_c')} AS gross_amount FROM ord WHERE date_key = 19980315"""))
def src_6(s):
    return tables.lookup(s.orders, "date_key", 19980315).select(
        "order_key", "date_key", "gross_amount")


@query("src_3_read_csv", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def src_3(s):
    """Suppliers exported as CSV and scanned with a declared schema."""
    path = scratch_path(s.spark, "csv")
    sinks.export(s.raw("supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "csv")
    return tables.read_csv(s.spark, path, StructType.fromDDL(
        "s_suppkey long, s_name string, s_nationkey int"))


@query("snk_1_write_mart", sql("ord", f"""
SELECT channel_key, count(*) AS orders, {eur('sum(gross_c)')} AS gross FROM ord GROUP BY channel_key"""))
def snk_1(s):
    """A mart written, replaced and read back."""
    root = scratch_path(s.spark, "root")
    mart = s.orders.groupBy("channel_key").agg(F.count(F.lit(1)).alias("orders"),
                                               F.sum("gross_amount").alias("gross"))
    sinks.write_mart(mart.filter("orders < 0"), root, "channel_totals")
    sinks.write_mart(mart, root, "channel_totals")
    return tables.read_table(s.spark, root, "mart.channel_totals")


@query("snk_2_replace_model_table", sql("ord", f"""
SELECT 'channel' AS kind, channel_key AS k, count(*) AS orders, {eur('sum(gross_c)')} AS gross, 1 AS kept_versions
FROM ord GROUP BY channel_key
UNION ALL SELECT 'zone', zone_key, count(*), {eur('sum(gross_c)')}, 1 FROM ord WHERE zone_key IS NOT NULL
GROUP BY zone_key"""))
def snk_2(s):
    """Two tables in one commit; then one of them is replaced, the other is not touched."""
    shelf = Shelf(s.spark, scratch_path(s.spark, "models"))

    def totals(kind, key, orders):
        return orders.groupBy(F.col(key).cast("int").alias("k")).agg(
            F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gross")).withColumn("kind", F.lit(kind))

    with shelf.change() as change:
        change.put(totals("channel", "channel_key", s.orders), "by_channel")
        change.put(totals("zone", "zone_key", s.orders.filter("is_cancelled")), "by_zone")
    before = shelf.snapshot()[1]["by_channel"]
    with shelf.change() as change:
        change.put(totals("zone", "zone_key", s.orders.filter("zone_key is not null")), "by_zone")
    same = int(shelf.snapshot()[1]["by_channel"] == before)
    return shelf.read("by_channel").unionByName(shelf.read("by_zone")).withColumn("kept_versions", F.lit(same))


@query("snk_4_load_transaction", """
SELECT 'customers' AS loaded, count(*) AS n, round(sum(c_acctbal), 2) AS total, TRUE AS bad_load_refused FROM customer
UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2), TRUE
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def snk_4_load(s):
    """Customers with half of the orders, then the other half; a third load with an
    order of no customer is refused and leaves both tables as they were."""
    path = scratch_path(s.spark, "core")
    customers = s.raw("customer").select(F.col("c_custkey").alias("customer_key"),
                                         F.col("c_acctbal").cast("decimal(14,2)").alias("balance"))
    orders = s.raw("orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"),
                                    F.col("o_totalprice").cast("decimal(14,2)").alias("total")
                                    ).join(customers.select("customer_key"), "customer_key", "left_semi")
    schemas = {"customers": "customer_key long not null, balance decimal(14,2)",
               "orders": "order_key long not null, customer_key long not null, total decimal(14,2) not null"}

    def put(**tables):
        load.load(s.spark, path, tables, schemas=schemas, order=["customers", "orders"],
                  keys={"customers": ["customer_key"], "orders": ["order_key"]},
                  parents={"orders": {"customer_key": ("customers", "customer_key")}},
                  sums={"customers": ["balance"], "orders": ["total"]})

    put(customers=customers, orders=orders.filter("order_key % 2 = 0"))
    put(orders=orders.filter("order_key % 2 <> 0"))
    strange = orders.limit(1).select(F.lit(-1).cast("long").alias("order_key"), F.lit(-1).cast("long").alias("customer_key"),
                                     "total")
    newcomer = customers.limit(1).withColumn("customer_key", F.lit(-2).cast("long"))
    try:
        put(customers=newcomer, orders=strange)
        refused = False
    except QualityError:
        refused = True
    shelf = Shelf(s.spark, path)
    told = [shelf.read(n).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total")).withColumn("loaded", F.lit(n))
            for n, c in (("customers", "balance"), ("orders", "total"))]
    return told[0].unionByName(told[1]).select("loaded", "n", F.col("total").cast("double").alias("total"),
                                               F.lit(refused).alias("bad_load_refused"))


@query("snk_3_export", "SELECT n_nationkey, n_name FROM nation")
def snk_3(s):
    path = scratch_path(s.spark, "export")
    sinks.export(s.raw("nation").select("n_nationkey", "n_name"), path, "parquet")
    return s.spark.read.parquet(path)


@query("snk_4_bulk_append", """
SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS l_quantity, count(*) AS copies FROM lineitem
GROUP BY ALL""")
def snk_4(s):
    """Whole-number doubles coerced to the integer target and appended."""
    path = scratch_path(s.spark, "append")
    target = StructType.fromDDL("l_orderkey long, l_quantity int")
    sinks.bulk_append(s.raw("lineitem").select("l_orderkey", "l_quantity"), target, path)
    return s.spark.read.parquet(path).groupBy("l_orderkey", "l_quantity").agg(
        F.count(F.lit(1)).alias("copies"))


@query("snk_5_upsert_latest", f"""
SELECT {day('business_date')}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS entered_at, event_id AS seq,
  event_type AS entered_by, value AS gross_revenue, user_id % 40 AS total_orders
FROM (SELECT *, CAST(ts AS DATE) - 8202 AS business_date, row_number() OVER (
        PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def snk_5(s):
    return sinks.upsert_latest(s.entry_log, "business_date", ["entered_at", "seq"])


@query("snk_6_manifest", sql("ord", f"""
SELECT 'customer' AS table_name, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM customer
UNION ALL SELECT 'part', 'rows', count(*) FROM part
UNION ALL SELECT 'lineitem', 'rows', count(*) FROM lineitem
UNION ALL SELECT 'fct_order', 'rows', count(*) FROM ord
UNION ALL SELECT 'fct_order', 'net_revenue', {eur('sum(net_c)')} FROM ord
UNION ALL SELECT 'fct_order', 'gross_amount', {eur('sum(gross_c)')} FROM ord"""))
def snk_6(s):
    return sinks.manifest(
        {"customer": s.raw("customer"), "part": s.raw("part"),
         "lineitem": s.raw("lineitem"), "fct_order": s.orders},
        {"fct_order": {"net_revenue": "net_revenue", "gross_amount": "gross_amount"}})


# ------------------------------------------------------------------ filters


@query("flt_1_delivery_only", sql("ord", """
SELECT order_key, zone_key, actual_min FROM ord WHERE is_delivery AND actual_min IS NOT NULL"""))
def flt_1(s):
    o = s.order_heads
    return o.filter(F.col("is_delivery") & F.col("actual_min").isNotNull()).select(
        "order_key", "zone_key", "actual_min")


@query("flt_2_in_period", sql("dayn", f"""
SELECT {day('full_date')}, orders, {eur('gross_c')} AS gross_revenue FROM dayn
WHERE full_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'"""))
def flt_2(s):
    return series.in_period(day_orders(s), "full_date", "1997-01-01", "1998-06-30").select(
        "full_date", "orders", "gross_revenue")


@query("flt_3_temporal_split", sql("head", f"""
SELECT part, count(*) AS orders, {day('min(full_date)', 'first_day')}, {day('max(full_date)', 'last_day')}
FROM (SELECT full_date, CASE WHEN full_date <= (SELECT max(full_date) FROM head) - 60
        THEN 'observed' ELSE 'outcome' END AS part FROM head) GROUP BY part"""))
def flt_3(s):
    dated = s.order_heads.select(date_of_key("date_key")
                                 .alias("full_date"))
    seen, later = series.temporal_split(dated, "full_date", 60)
    both = combine.union_tagged({"observed": seen, "outcome": later}, "part")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("orders"),
                                    F.min("full_date").alias("first_day"),
                                    F.max("full_date").alias("last_day"))


@query("flt_4_isin", sql("head", """
SELECT channel_key, count(*) AS orders FROM head WHERE channel_key IN (2, 4)
  AND zone_key NOT IN (1, 3) GROUP BY channel_key"""))
def flt_4(s):
    return (s.order_heads.filter(F.col("channel_key").isin(2, 4) & ~F.col("zone_key").isin(1, 3))
            .groupBy("channel_key").agg(F.count(F.lit(1)).alias("orders")))


@query("flt_5_not_null", sql("head", """
SELECT order_key, promo_code FROM head WHERE promo_code IS NOT NULL"""))
def flt_5(s):
    return s.order_heads.filter(F.col("promo_code").isNotNull()).select(
        "order_key", "promo_code")


@query("flt_6_conditional_mask", sql("ord", f"""
SELECT channel_key, count(*) FILTER (WHERE is_late) AS late,
  CAST(sum(CASE WHEN is_delivery THEN actual_min END) AS BIGINT) AS minutes,
  {eur('sum(CASE WHEN is_cancelled THEN gross_c ELSE 0 END)')} AS cancelled_value
FROM ord GROUP BY channel_key"""))
def flt_6(s):
    return s.orders.groupBy("channel_key").agg(
        F.count_if("is_late").alias("late"),
        F.sum(F.when(F.col("is_delivery"), F.col("actual_min"))).alias("minutes"),
        F.sum(F.when(F.col("is_cancelled"), F.col("gross_amount")).otherwise(0))
        .alias("cancelled_value"))


# -------------------------------------------------------------------- joins


@query("join_1_fact_dimension", sql("ord zone", f"""
SELECT order_key, district_name, {eur('gross_c')} AS gross_amount
FROM ord JOIN zone USING (zone_key)"""))
def join_1(s):
    return s.orders.join(s.zones, "zone_key").select("order_key", "district_name",
                                                     "gross_amount")


@query("join_2_day_calendar", sql("dayn cal", f"""
SELECT date_key, {day('c.full_date', 'full_date')}, day_name, orders FROM dayn d JOIN cal c USING (full_date)"""))
def join_2(s):
    per = s.order_heads.groupBy("date_key").agg(F.count(F.lit(1)).alias("orders"))
    return per.join(s.plain_calendar, "date_key").select("date_key", "full_date", "day_name",
                                                         "orders")


@query("join_3_left_costs", sql("cal shift", f"""
SELECT date_key, {eur('labour_c')} AS labour_cost FROM cal LEFT JOIN shift USING (date_key)"""))
def join_3(s):
    return s.plain_calendar.join(s.shifts, "date_key", "left").select("date_key", "labour_cost")


@query("join_4_anti", sql("entry head", f"""
SELECT {day('business_date')}, total_orders FROM entry
WHERE business_date NOT IN (SELECT full_date FROM head)"""))
def join_4(s):
    dates = s.order_heads.select(date_of_key("date_key")
                                 .alias("full_date"))
    return combine.exclude_keys(s.entries, dates, "business_date", "full_date").select(
        "business_date", "total_orders")


@query("join_5_semi_flag", sql("cust head", """
SELECT customer_key, customer_key IN (SELECT customer_key FROM head WHERE full_date >= DATE '2001-06-01')
  AS returned FROM cust"""))
def join_5(s):
    recent = s.order_heads.filter(F.col("date_key") >= 20010601)
    return combine.flag_members(s.customers.select("customer_key"), recent, "customer_key",
                                "returned")


@query("join_6_in_spans", sql("cal", f"SELECT {day('full_date')}, is_school_holiday AS in_span FROM cal"))
def join_6(s):
    return combine.in_spans(s.plain_calendar.select("full_date"), "full_date", s.spans)


@query("join_7_same_weekday_last_week", sql("dayn", f"""
SELECT {day('a.full_date', 'full_date')}, a.orders, b.orders AS orders_7d_ago
FROM dayn a LEFT JOIN dayn b ON b.full_date = a.full_date - 7"""))
def join_7(s):
    return series.with_lag_days(day_orders(s).select("full_date", "orders"), "full_date",
                                "orders", 7)


@query("join_8_star", sql("ord zone cal dayn", f"""
SELECT order_key, district_name, c.day_of_week, is_rainy, n.orders AS orders_that_day
FROM ord o JOIN zone z ON z.zone_key = o.zone_key JOIN cal c ON c.date_key = o.date_key
JOIN dayn n ON n.full_date = c.full_date"""))
def join_8(s):
    daily = s.order_heads.groupBy("date_key").agg(F.count(F.lit(1)).alias("orders_that_day"))
    return (s.order_heads.join(s.zones, "zone_key").join(s.calendar, "date_key")
            .join(daily, "date_key")
            .select("order_key", "district_name", "day_of_week", "is_rainy",
                    "orders_that_day"))


@query("join_9_holiday_lookup", sql("cal", f"SELECT {day('full_date')}, holiday_name FROM cal"))
def join_9(s):
    names = s.holidays.withColumnRenamed("holiday_date", "full_date")
    return combine.with_lookup(s.plain_calendar.select("full_date"), names, "full_date")


@query("join_10_item_sizes", sql("item", f"""
SELECT item_key, item_name, v.size_label, (2 * price_c * pct + 100) // 200 / 100.0::DOUBLE AS price
FROM item, (VALUES ('small', 100), ('normal', 128), ('family', 220)) AS v(size_label, pct)"""))
def join_10(s):
    sizes = [{"size_label": n, "factor": f} for n, f in
             [("small", "1.00"), ("normal", "1.28"), ("family", "2.20")]]
    return combine.with_variants(s.items, sizes, "size_label string, factor decimal(4,2)").select(
        "item_key", "item_name", "size_label",
        F.round(F.col("unit_price") * F.col("factor"), 2).alias("price"))


# --------------------------------------------------------------- aggregates


@query("agg_1_group_by", sql("ord", f"""
SELECT zone_key, count(*) AS orders, {eur('sum(gross_c)')} AS gross, {eur('min(gross_c)')} AS lo,
  {eur('max(gross_c)')} AS hi, {ratio('sum(gross_c)', 'count(*) * 100')} AS mean
FROM ord GROUP BY zone_key"""))
def agg_1(s):
    return s.orders.groupBy("zone_key").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gross"),
        F.min("gross_amount").alias("lo"), F.max("gross_amount").alias("hi"),
        safe_ratio(F.sum("gross_amount"), F.count(F.lit(1))).alias("mean"))


@query("agg_2_conditional", sql("head", """
SELECT customer_key, count(*) FILTER (WHERE is_delivery) AS deliveries,
  count(*) FILTER (WHERE NOT is_delivery) AS pickups, count(*) FILTER (WHERE is_cancelled) AS cancelled
FROM head GROUP BY customer_key"""))
def agg_2(s):
    return s.order_heads.groupBy("customer_key").agg(
        F.count_if("is_delivery").alias("deliveries"),
        F.count_if(~F.col("is_delivery")).alias("pickups"),
        F.count_if("is_cancelled").alias("cancelled"))


@query("agg_3_count_distinct", """
SELECT l_partkey AS item_key, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1""")
def agg_3(s):
    return s.lines.groupBy("item_key").agg(F.countDistinct("order_key").alias("orders"))


@query("agg_4_safe_ratio", sql("ord", f"""
SELECT date_key, {ratio('count(*) FILTER (WHERE is_late)', 'count(*) FILTER (WHERE is_delivery)', 100, 1)} AS late_pct,
  {ratio('sum(disc_c)', 'sum(gross_c)', 100, 1)} AS discount_pct FROM ord GROUP BY date_key"""))
def agg_4(s):
    return s.orders.groupBy("date_key").agg(
        safe_ratio(F.count_if("is_late"), F.count_if("is_delivery"), 100, 1).alias("late_pct"),
        safe_ratio(F.sum("discount_amount"), F.sum("gross_amount"), 100, 1)
        .alias("discount_pct"))


QUANTILES = """
SELECT zone_key, round(quantile_cont(actual_min, 0.8), 6) AS p80,
  round(quantile_cont(actual_min, 0.95), 6) AS p95 FROM ord WHERE actual_min IS NOT NULL
GROUP BY zone_key"""


@query("agg_5_quantiles", sql("ord", QUANTILES))
def agg_5(s):
    q = agg.group_quantiles(s.order_heads, ["zone_key"], "actual_min", [0.8, 0.95])
    return q.select("zone_key", F.round("p80", 6).alias("p80"), F.round("p95", 6).alias("p95"))


@query("agg_5_quantiles_wide_domain", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1""")
def agg_5_wide(s):
    """Quantiles of prices: no group is ever held by one task."""
    q = agg.group_quantiles(s.raw("lineitem"), ["l_returnflag"], "l_extendedprice",
                            [0.5, 0.9], wide_domain=True)
    return q.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@query("agg_6_rate", sql("ord", """
SELECT zone_key, round(avg(CAST(is_late AS INTEGER)), 6) AS late_rate FROM ord GROUP BY zone_key"""))
def agg_6(s):
    o = s.order_heads.withColumn("is_late", F.col("actual_min") > F.col("promised_min"))
    return o.groupBy("zone_key").agg(F.round(agg.rate("is_late"), 6).alias("late_rate"))


@query("agg_7_global", sql("ord", f"""
SELECT {day('max(full_date)', 'last_day')}, count(*) AS orders, {eur('sum(net_c)')} AS net FROM ord"""))
def agg_7(s):
    return s.orders.agg(date_of_key(F.max("date_key")).alias("last_day"),
                        F.count(F.lit(1)).alias("orders"), F.sum("net_revenue").alias("net"))


@query("agg_8_mean_of_counts", sql("dayn", "SELECT round(avg(orders), 6) AS orders_per_day FROM dayn"))
def agg_8(s):
    m = agg.mean_group_count(s.order_heads, ["date_key"], "m")
    return m.select(F.round("m", 6).alias("orders_per_day"))


@query("agg_9_median_mad", sql("dayn", """
SELECT dow, round(max(med), 6) AS median, round(median(abs(gross_c - med)), 6) AS mad,
  round(stddev_samp(gross_c), 3) AS stddev
FROM (SELECT isodow(full_date) AS dow, gross_c, median(gross_c) OVER (PARTITION BY isodow(full_date)) AS med
      FROM dayn) GROUP BY dow"""))
def agg_9(s):
    d = day_orders(s).select((F.weekday("full_date") + 1).alias("dow"),
                             (F.col("gross_revenue") * 100).cast("long").alias("cents"))
    return agg.median_mad(d, ["dow"], "cents").select(
        F.col("dow").cast("long").alias("dow"), F.round("median", 6).alias("median"),
        F.round("mad", 6).alias("mad"), F.round("stddev", 3).alias("stddev"))


@query("agg_10_share_of_total", sql("ord", f"""
SELECT channel_key, {eur('sum(gross_c)')} AS gross,
  {ratio('sum(gross_c)', '(SELECT sum(gross_c) FROM ord)', 1, 4)} AS share FROM ord GROUP BY channel_key"""))
def agg_10(s):
    per = s.orders.groupBy("channel_key").agg(F.sum("gross_amount").alias("gross"))
    return agg.share_of_total(per, "gross")


@query("agg_11_value_counts", sql("head", "SELECT channel_key, count(*) AS n FROM head GROUP BY 1"))
def agg_11(s):
    return agg.value_counts(s.order_heads, "channel_key")


@query("agg_12_first_seen", sql("head", "SELECT customer_key, min(date_key) AS first_key FROM head GROUP BY 1"))
def agg_12(s):
    return agg.first_seen(s.order_heads, "customer_key", "date_key", "first_key")


@query("agg_13_stddev", sql("ord", """
SELECT zone_key, round(stddev_samp(actual_min), 6) AS sd FROM ord GROUP BY zone_key"""))
def agg_13(s):
    return s.order_heads.groupBy("zone_key").agg(
        F.round(F.stddev_samp("actual_min"), 6).alias("sd"))


# ------------------------------------------------------------------ windows


@query("win_1_trailing_rows", sql("dayn", f"""
SELECT {day('full_date')}, orders, CASE WHEN count(*) OVER w = 7 THEN round(avg(orders) OVER w, 6) END
  AS trailing_mean
FROM dayn WINDOW w AS (ORDER BY full_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def win_1(s):
    t = series.trailing_mean_rows(day_orders(s).select("full_date", "orders"), "full_date", "orders")
    return t.withColumn("trailing_mean", F.round("trailing_mean", 6))


@query("win_2_trailing_days", sql("dayn", f"""
SELECT {day('full_date')}, orders, round(avg(orders) OVER (ORDER BY full_date
  RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM dayn"""))
def win_2(s):
    t = series.trailing_mean_days(day_orders(s).select("full_date", "orders"), "full_date", "orders")
    return t.withColumn("trailing_mean", F.round("trailing_mean", 6))


@query("win_3_year_to_date", sql("dayn", f"""
SELECT {day('full_date')}, orders, CAST(sum(orders) OVER (PARTITION BY year(full_date) ORDER BY full_date)
  AS BIGINT) AS ytd FROM dayn"""))
def win_3(s):
    return series.year_to_date(day_orders(s).select("full_date", "orders"), "full_date", "orders")


@query("win_4_fill_gaps", sql("weather", f"""
SELECT {day('full_date')}, coalesce(last_value(temp_raw IGNORE NULLS) OVER a,
  first_value(temp_raw IGNORE NULLS) OVER b) AS temp_mean_c
FROM weather WINDOW a AS (ORDER BY full_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (ORDER BY full_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def win_4(s):
    return series.fill_gaps(s.weather.select("full_date", "temp_mean_c"), "full_date",
                            ["temp_mean_c"], "both")


register("spend", """
  SELECT customer_key, count(*) AS frequency, CAST(sum(gross_c) AS BIGINT) AS monetary_c,
    (SELECT max(full_date) FROM head) - max(full_date) AS recency FROM ord GROUP BY customer_key""",
         ["ord"])


def spend(s):
    last = date_of_key(F.max("date_key"))
    asof = s.bounds.select("end").scalar()
    return s.orders.groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("frequency"), F.sum("gross_amount").alias("monetary"),
        F.datediff(asof, last).alias("recency"))


@query("win_5_global_rank", sql("spend", """
SELECT customer_key, frequency, row_number() OVER (ORDER BY frequency, customer_key) AS rank FROM spend"""))
def win_5(s):
    return order.global_rank(spend(s).select("customer_key", "frequency"),
                             ["frequency", "customer_key"])


@query("win_6_value_quintile", sql("spend", """
SELECT customer_key, recency, CAST(5 - ((recency > round(q[1], 9))::INT + (recency > round(q[2], 9))::INT
  + (recency > round(q[3], 9))::INT + (recency > round(q[4], 9))::INT) AS INTEGER) AS r_score
FROM spend, (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS q FROM spend)"""))
def win_6(s):
    return order.value_quintile(spend(s).select("customer_key", "recency"), "recency", "r_score",
                                reverse=True)


RANK_SCORE = "CAST(greatest(1, (5 * (rn - 1) + n - 2) // (n - 1)) AS INTEGER)"


@query("win_7_rank_quintile", sql("spend", f"""
SELECT customer_key, frequency, {RANK_SCORE} AS f_score
FROM (SELECT *, row_number() OVER (ORDER BY frequency, customer_key) AS rn,
        count(*) OVER () AS n FROM spend)"""))
def win_7(s):
    return order.rank_quintile(spend(s).select("customer_key", "frequency"), "frequency",
                               ["customer_key"], "f_score")


@query("win_8_fixed_bins", """
SELECT o_orderkey AS order_key, CASE WHEN s <= 0.33 THEN 'Low' WHEN s <= 0.66 THEN 'Medium'
  ELSE 'High' END AS band FROM (SELECT *, (o_orderkey % 101) / 100.0::DOUBLE AS s FROM orders)""")
def win_8(s):
    score = (F.col("order_key") % 101) / F.lit(100.0)
    return s.order_heads.select("order_key", bin_fixed(
        score, [-0.01, 0.33, 0.66, 1.01], ["Low", "Medium", "High"]).alias("band"))


@query("win_9_row_numbers", sql("spend", f"""
SELECT row_number() OVER (ORDER BY monetary_c DESC, customer_key) AS row_key, customer_key,
  {eur('monetary_c')} AS monetary FROM spend"""))
def win_9(s):
    return order.number_rows(spend(s).select("customer_key", "monetary"),
                             [F.col("monetary").desc(), "customer_key"], "row_key")


@query("win_10_group_stat", sql("dayn", f"""
SELECT {day('full_date')}, orders, round(avg(orders) OVER (PARTITION BY isodow(full_date)), 6) AS typical
FROM dayn"""))
def win_10(s):
    d = day_orders(s).select("full_date", "orders", F.weekday("full_date").alias("dow"))
    return series.with_group_stat(d, ["dow"], typical=F.round(F.avg("orders"), 6)).drop("dow")


@query("win_11_period_change", sql("dayn", f"""
SELECT {day('a.full_date', 'full_date')}, {eur('a.gross_c')} AS gross_revenue,
  {eur('b.gross_c')} AS gross_revenue_7d_ago, {ratio('a.gross_c - b.gross_c', 'b.gross_c', 100, 1)} AS change_pct
FROM dayn a LEFT JOIN dayn b ON b.full_date = a.full_date - 7"""))
def win_11(s):
    return series.period_change(day_orders(s).select("full_date", "gross_revenue"), "full_date",
                                "gross_revenue")


@query("win_12_last_n", sql("dayn", f"""
SELECT {day('full_date')}, year(full_date)::INT AS year, orders FROM dayn QUALIFY row_number() OVER (
  PARTITION BY year(full_date) ORDER BY full_date DESC) <= 28"""))
def win_12(s):
    return series.last_n(day_orders(s).select("full_date", "year", "orders"), "full_date", 28,
                         ["year"])


@query("win_13_lag_rows", sql("dayn", f"""
SELECT {day('full_date')}, orders, lag(orders, 7) OVER (ORDER BY full_date) AS orders_lag7 FROM dayn"""))
def win_13(s):
    return series.lag_rows(day_orders(s).select("full_date", "orders"), "full_date", "orders", 7)


# -------------------------------------------------------- sort, top-k, sets


@query("srt_1_sort", sql("dayn", f"SELECT {day('full_date')}, orders FROM dayn ORDER BY 2 DESC, 1"))
def srt_1(s):
    return order.sort_rows(day_orders(s).select("full_date", "orders"),
                           F.col("orders").desc(), "full_date")


@query("srt_2_top_k", sql("spend", f"""
SELECT customer_key, {eur('monetary_c')} AS monetary FROM spend
ORDER BY monetary_c DESC, customer_key LIMIT 50"""))
def srt_2(s):
    return order.top_k(spend(s).select("customer_key", "monetary"),
                       [F.col("monetary").desc(), "customer_key"], 50)


@query("srt_3_sort_by_key", sql("dayn cal", f"""
SELECT month, month_name, CAST(sum(orders) AS BIGINT) AS orders FROM dayn JOIN cal USING (full_date)
GROUP BY ALL ORDER BY month"""))
def srt_3(s):
    d = s.order_heads.join(s.plain_calendar, "date_key").groupBy("month", "month_name").agg(
        F.count(F.lit(1)).alias("orders"))
    return order.sort_rows(d, "month")


@query("srt_4_latest_entries", sql("entry", f"""
SELECT {day('business_date')}, total_orders, {eur('gross_c')} AS gross_revenue FROM entry
ORDER BY business_date DESC LIMIT 7"""))
def srt_4(s):
    return order.latest_entries(s.entries.select("business_date", "total_orders",
                                                 "gross_revenue"), "business_date", 7)


@query("set_1_union_tagged", sql("dayn entry", f"""
SELECT {day('full_date', 'business_date')}, orders AS total_orders, trips AS trips, 'history' AS source FROM dayn
UNION ALL SELECT {day('business_date')}, total_orders, NULL, 'form' FROM entry"""))
def set_1(s):
    a = day_orders(s).select(F.col("full_date").alias("business_date"),
                             F.col("orders").alias("total_orders"), "trips")
    return combine.union_tagged({"history": a,
                                 "form": s.entries.select("business_date", "total_orders")})


@query("set_2_metrics_long", sql("dayn", f"""
SELECT {day('full_date')}, 'orders' AS metric, CAST(orders AS DOUBLE) AS value FROM dayn
UNION ALL SELECT {day('full_date')}, 'trips', CAST(trips AS DOUBLE) FROM dayn
UNION ALL SELECT {day('full_date')}, 'gross', {eur('gross_c')} FROM dayn"""))
def set_2(s):
    return combine.unpivot_lines(
        day_orders(s), {n: F.col(c).cast("double") for n, c in [
            ("orders", "orders"), ("trips", "trips"), ("gross", "gross_revenue")]},
        "metric", "value", keep=["full_date"])


@query("set_3_replace_by_key", sql("dayn entry", f"""
SELECT {day('full_date', 'business_date')}, orders AS total_orders FROM dayn
WHERE full_date NOT IN (SELECT business_date FROM entry)
UNION ALL SELECT {day('business_date')}, total_orders FROM entry"""))
def set_3(s):
    old = day_orders(s).select(F.col("full_date").alias("business_date"),
                               F.col("orders").alias("total_orders"))
    return combine.replace_by_key(old, s.entries.select("business_date", "total_orders"),
                                  "business_date")


@query("set_4_missing_dates", sql("days head", f"""
SELECT {day('full_date')} FROM days WHERE full_date NOT IN (SELECT full_date FROM head)"""))
def set_4(s):
    have = s.order_heads.select(date_of_key("date_key")
                                .alias("full_date"))
    return combine.missing_keys(s.plain_calendar, have, "full_date")


@query("set_5_unpivot_lines", sql("ord", f"""
SELECT channel_key, line, {eur('c')} AS amount FROM (
  SELECT channel_key, unnest(['gross', 'discount', 'commission', 'food']) AS line,
    unnest([sum(gross_c), -sum(disc_c), -sum(comm_c), -sum(food_c)]) AS c FROM ord GROUP BY channel_key)"""))
def set_5(s):
    per = s.orders.groupBy("channel_key").agg(*[F.sum(c).alias(c) for c in [
        "gross_amount", "discount_amount", "commission_amount", "food_cost"]])
    return combine.unpivot_lines(per, {
        "gross": money("gross_amount"), "discount": money(-F.col("discount_amount")),
        "commission": money(-F.col("commission_amount")), "food": money(-F.col("food_cost"))},
        keep=["channel_key"])


@query("set_6_pivot_counts", sql("head", """
SELECT date_key, count(*) FILTER (WHERE channel_key = 1) AS "1", count(*) FILTER (WHERE channel_key = 2) AS "2",
  count(*) FILTER (WHERE channel_key = 3) AS "3", count(*) FILTER (WHERE channel_key = 4) AS "4",
  count(*) FILTER (WHERE channel_key = 5) AS "5" FROM head GROUP BY date_key"""))
def set_6(s):
    return combine.pivot_counts(s.order_heads, "date_key", "channel_key", [1, 2, 3, 4, 5])


# --------------------------------------------------------- scalar functions


@query("fn_scalar_functions", sql("ord", f"""
SELECT order_key, coalesce(promo_code, '-') AS promo, nullif(item_qty, 0) AS qty_or_null,
  CASE WHEN disc_c > 0 THEN 'discount' ELSE 'full' END AS kind,
  lpad(CAST(channel_key AS VARCHAR), 3, '0') || '/' || strftime(full_date, '%Y-%m') AS label,
  quarter(full_date)::INT AS quarter, weekofyear(full_date)::INT AS iso_week,
  isodow(full_date)::INT AS weekday, (DATE '2001-08-01' - full_date)::INT AS age_days,
  {day('full_date + 7', 'next_week')}, CAST(ceil(actual_min / 5.0) * 5 AS INTEGER) AS up5,
  round_even(actual_min / 2.0, 0) AS half_even, round(ln(1 + item_qty), 6) AS log_qty,
  CASE daypart WHEN 'Mittag' THEN 0 WHEN 'Nachmittag' THEN 1 WHEN 'Abend' THEN 2 ELSE 3 END AS code,
  TRY_CAST(promo_code AS INTEGER) AS promo_number FROM ord"""))
def fn_scalar(s):
    d = date_of_key("date_key")
    return s.orders.select(
        "order_key", F.coalesce("promo_code", F.lit("-")).alias("promo"),
        F.nullif("item_qty", F.lit(0)).alias("qty_or_null"),
        F.when(F.col("discount_amount") > 0, "discount").otherwise("full").alias("kind"),
        F.concat(F.lpad(F.col("channel_key").cast("string"), 3, "0"), F.lit("/"),
                 F.date_format(d, "yyyy-MM")).alias("label"),
        F.quarter(d).alias("quarter"), F.weekofyear(d).alias("iso_week"),
        (F.weekday(d) + 1).alias("weekday"),
        F.datediff(F.lit("2001-08-01").cast("date"), d).alias("age_days"),
        F.date_add(d, 7).alias("next_week"),
        (F.ceil(F.col("actual_min") / 5) * 5).cast("int").alias("up5"),
        F.bround(F.col("actual_min") / 2, 0).alias("half_even"),
        F.round(F.log(1 + F.col("item_qty")), 6).alias("log_qty"),
        value_map("daypart", {"Mittag": 0, "Nachmittag": 1, "Abend": 2}, 3).alias("code"),
        F.col("promo_code").try_cast("int").alias("promo_number"))
