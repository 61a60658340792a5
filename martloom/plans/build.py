"""Nightly build: core tables to marts to model tables.

    spark-submit martloom/plans/build.py CORE_ROOT OUT_ROOT [--models]
"""

import sys
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.operators import anomaly, basket, customers, delivery, forecast, quality
from martloom.operators.stable import release, stable
from martloom.plans import marts
from martloom.sources.schemas import SCHEMAS
from martloom.sources.shelf import Shelf
from martloom.sources.sinks import manifest
from martloom.sources.tables import read_table

MARTS = ["dim_date", "dim_item", "dim_zone", "dim_channel", "dim_driver", "dim_customer",
         "fct_order", "fct_order_item", "kpi_daily", "kpi_zone", "kpi_item",
         "kpi_channel_daily", "dim_cost_assumption", "daily_entry", "daily_actuals"]
MODELS = ["forecast_daily", "customer_rfm", "customer_churn", "delivery_promise",
          "delivery_factors", "basket_rules", "anomaly_daily"]
FACTS = ("fct_order", "fct_order_item")


def build_marts(core: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The fifteen reporting marts as lazy frames."""
    orders, cal = core["fct_order"], core["dim_date"]
    kpi = marts.kpi_daily(orders, core["fct_shift"], cal)
    entries = marts.mart_daily_entry(core["daily_entry"])
    return {
        "dim_date": marts.mart_dim_date(cal), "dim_item": marts.mart_dim_item(core["dim_item"]),
        "dim_zone": marts.mart_dim_zone(core["dim_zone"]),
        "dim_channel": marts.mart_dim_channel(core["dim_channel"]),
        "dim_driver": marts.mart_dim_driver(core["dim_driver"]),
        "dim_customer": marts.customer_base(core["dim_customer"], orders, cal),
        "fct_order": marts.mart_fct_order(orders),
        "fct_order_item": marts.mart_fct_order_item(core["fct_order_item"]),
        "kpi_daily": kpi, "kpi_zone": marts.kpi_zone(orders, core["dim_zone"]),
        "kpi_item": marts.kpi_item(core["fct_order_item"], core["dim_item"]),
        "kpi_channel_daily": marts.kpi_channel_daily(orders, core["dim_channel"], cal),
        "dim_cost_assumption": marts.mart_cost_assumption(core["dim_cost_assumption"]),
        "daily_entry": entries, "daily_actuals": marts.daily_actuals(kpi, entries)}


def rebuild(spark: SparkSession, core: Mapping[str, DataFrame], out_root: str, gates=None) -> DataFrame:
    """Replace every mart in one commit; facts are partitioned by month, and only
    months that differ are written. ``gates(read)`` may look at the marts as they will
    be and raise: then none is replaced. Returns the row-count manifest."""
    built = build_marts(core)
    with Shelf(spark, f"{out_root}/mart").change() as change:
        for name in MARTS:
            df = built[name]
            if name == "daily_actuals":
                # from the written marts, so the daily totals are not computed twice
                df = marts.daily_actuals(change.read("kpi_daily"), change.read("daily_entry"))
            if name in FACTS:
                month = F.floor(F.col("date_key") / 100).cast("int")
                change.put(df.withColumn("month_key", month), name, ["month_key"], "changed")
            else:
                change.put(df, name)
        if gates is not None:
            gates(change.read)
    return manifest({n: read_table(spark, out_root, f"mart.{n}") for n in MARTS})


def consistent(read) -> None:
    """A gate: no order and no day twice, no line without its order."""
    quality.require(quality.check_unique(read("fct_order"), "order_key"), "order keys")
    quality.require(quality.check_unique(read("kpi_daily"), "date_key"), "days")
    quality.require(quality.check_fk(read("fct_order_item"), "order_key", read("fct_order"), "order_key"), "order lines")


def build_models(m: Mapping[str, DataFrame], weather: DataFrame, holidays: DataFrame,
                 spans: DataFrame, churn_rounds: int = 200, trees: int = 400,
                 horizon: int = 14, min_support: float = 0.01) -> dict[str, DataFrame]:
    """The seven model tables from stored marts."""
    kpi, items = m["kpi_daily"], m["dim_item"]
    dated = m["fct_order"].join(m["dim_date"].select("date_key", "full_date"), "date_key")
    frame = forecast.forecast_frame(kpi)
    future = forecast.future_frame(frame.select("ds"), horizon, weather, holidays, spans)
    trips = stable(delivery.delivery_frame(m["fct_order"], m["dim_zone"], m["dim_date"], kpi),
                   "trips")
    model, test, _ = delivery.delivery_time_model(trips, trees=trees)
    churn, _ = customers.churn_model(customers.churn_features(dated), max_iter=churn_rounds)
    pairs = stable(basket.baskets(m["fct_order_item"], items), "baskets")
    return {
        "forecast_daily": forecast.forecast_daily(forecast.fit_forecast(frame), future, kpi),
        "customer_rfm": customers.rfm(dated), "customer_churn": churn,
        "delivery_promise": delivery.promise_times(trips),
        "delivery_factors": delivery.delivery_factors(model, test),
        "basket_rules": basket.pair_rules(pairs, min_support),
        "anomaly_daily": anomaly.anomaly_daily(kpi)}


def remodel(spark: SparkSession, out_root: str, weather, holidays, spans, **options) -> DataFrame:
    """Fit everything on the stored marts and replace the model tables, all in one
    commit."""
    stored = {n: read_table(spark, out_root, f"mart.{n}") for n in MARTS}
    with Shelf(spark, f"{out_root}/mart").change() as change:
        for name, df in build_models(stored, weather, holidays, spans, **options).items():
            change.put(df, name)
    return manifest({n: read_table(spark, out_root, f"mart.{n}") for n in MODELS})


def main(argv):
    core_root, out_root = argv[:2]
    spark = SparkSession.builder.appName("martloom-build").getOrCreate()
    core = {n: read_table(spark, core_root, n, s) for n, s in SCHEMAS.items()}
    rebuild(spark, core, out_root, consistent).show(50, False)
    if "--models" in argv:
        cal = core["dim_date"]
        holidays = cal.filter("is_public_holiday").select(
            F.col("full_date").alias("holiday_date"), "holiday_name")
        spans = cal.filter("is_school_holiday").select(
            F.lit("school").alias("name"), F.col("full_date").alias("start"),
            F.col("full_date").alias("end"))
        remodel(spark, out_root, cal, holidays, spans).show(50, False)
    release(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
