"""Core tables to stored marts to stored model tables."""

import os

import pytest

from martloom.operators.series import in_period
from martloom.operators.stable import release, stable
from martloom.plans import build
from martloom.sources.tables import read_table
from pyspark.sql import functions as F
from proving.star import Star

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_full_build(spark, tmp_path):
    s = Star(spark, SF)
    core = {"dim_date": s.calendar, "dim_item": s.items, "dim_zone": s.zones,
            "dim_channel": s.channels, "dim_driver": s.drivers,
            "dim_customer": s.customers.withColumn("first_order_date",
                                                   F.lit(None).cast("date")),
            "fct_order": s.orders, "fct_order_item": s.order_lines, "fct_shift": s.shifts,
            "dim_cost_assumption": s.assumptions, "daily_entry": s.entries}
    root = str(tmp_path)
    counts = {r.table_name: r.value for r in build.rebuild(spark, core, root).collect()}
    assert set(counts) == set(build.MARTS) and counts["fct_order"] == 1500
    assert counts["daily_actuals"] > counts["kpi_daily"]

    facts = read_table(spark, root, "mart.fct_order").withColumn("d", F.to_date("order_ts"))
    year = in_period(facts, "d", "1997-02-10", "1997-03-09", "month_key")
    plan = year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and year.count() > 0

    weather = s.weather.select(F.date_add("full_date", 14).alias("full_date"), "temp_mean_c",
                               "precipitation_mm")
    models = {r.table_name: r.value for r in build.remodel(
        spark, root, weather, s.holidays, s.spans, churn_rounds=3, trees=3,
        min_support=0.003).collect()}
    assert set(models) == set(build.MODELS)
    assert models["forecast_daily"] == 14 and models["delivery_promise"] == 25
    assert models["basket_rules"] == 200 and models["delivery_factors"] == 9


def test_stored_frames_can_be_released(spark):
    kept = stable(spark.range(5))
    assert kept.count() == 5
    assert release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception):
        kept.count()
