"""The registered queries: names, checks, and a sample run against SQL.
FULL=1 runs every query at the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from proving import QUERIES
from proving.verify import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["mart_1_kpi_daily", "mart_2_kpi_zone", "mart_5_customer_base", "mart_6_daily_actuals",
          "etl_3_weather", "prj_7_mart_fct_order_item", "win_7_rank_quintile", "cus_1_rfm",
          "bsk_3_pair_rules", "ano_4_flag_anomalies", "del_2_promise_times",
          "fct_2_future_frame", "dq_1_plausibility_gate", "rep_13_channel_economics",
          "agg_5_quantiles_wide_domain", "str_1_stream_entries", "str_2_stream_kpi"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_contract_names():
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140 and len(o) > 125
    assert not any(n.startswith(("op", "pipeline")) for n in QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("FULL") else SAMPLE)
def test_query_matches_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    text = contract.oracle_sql().get(name)
    assert df.columns if text is None else compare(df, connect(SF), text).startswith("ok")


@needs_data
def test_entry_runs(spark):
    df = contract.entry(spark)
    assert "operating_profit" in df.columns and df.count() > 0


@needs_data
def test_results_do_not_depend_on_partitioning(spark):
    """Same rows whatever the shuffle width."""
    from proving.verify import rows_of

    def run(name):
        df = contract.queries()[name](spark, SF)
        return rows_of(df.columns, df.collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["mart_1_kpi_daily", "cus_1_rfm", "bsk_3_pair_rules", "win_5_global_rank"]
    wide = [run(n) for n in names]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert [run(n) for n in names] == wide
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@needs_data
def test_nothing_depends_on_broadcasts(spark):
    """With broadcasting off every join takes its other way."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for name in ["mart_1_kpi_daily", "bsk_3_pair_rules", "win_5_global_rank"]:
            df = contract.queries()[name](spark, SF)
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
            assert compare(df, connect(SF), contract.oracle_sql()[name]).startswith("ok")
    finally:
        spark.conf.set(key, before)


@needs_data
def test_forecasts_are_fitted_on_earlier_days(spark):
    from pyspark.sql import functions as F

    from proving.q_models import before_horizon, future, kpi_full
    from proving.star import Star

    star = Star(spark, SF)
    last = before_horizon(star, kpi_full(star)).agg(F.max("full_date")).first()[0]
    first = future(star).agg(F.min("ds")).first()[0]
    assert last < first
