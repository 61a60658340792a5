"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each
query runs twice to warm up, then three times into the no-op sink; the
median counts. ``--all`` times every registered query once after warming.
"""

import json
import os
import statistics
import sys
import time

from proving import QUERIES
from proving.session import local_session

HEADLINE = [
    "mart_1_kpi_daily", "mart_2_kpi_zone", "mart_3_kpi_item", "mart_4_kpi_channel_daily",
    "mart_5_customer_base", "mart_6_daily_actuals", "prj_6_mart_fct_order",
    "prj_7_mart_fct_order_item", "etl_6_daily_costs", "agg_3_count_distinct",
    "agg_5_quantiles", "agg_5_quantiles_wide_domain", "win_5_global_rank", "cus_1_rfm",
    "cus_4_churn_features", "bsk_3_pair_rules", "ano_2_robust_residuals",
    "ano_4_flag_anomalies", "del_2_promise_times", "fct_4_backtest", "rep_5_pnl_lines",
    "rep_15_menu_quadrant", "dq_1_plausibility_gate", "dq_4_check_fk", "snk_5_upsert_latest",
    "str_2_stream_kpi"]


def run(fn, spark, sf_dir):
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times = {}
    for name in names:
        warm, timed = (1, 1) if "--all" in sys.argv else (2, 3)
        taken = [run(QUERIES[name], spark, sf_dir) for _ in range(warm + timed)][warm:]
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, warm median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
