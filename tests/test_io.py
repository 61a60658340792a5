"""Sources, sinks and streams."""

import datetime as dt
import json
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom import streaming
from martloom.operators.quality import QualityError
from martloom.sources import sinks, tables
from martloom.sources.entry_store import EntryStore
from martloom.sources.schemas import LOAD_ORDER, SCHEMAS
from helpers import dicts, rows, table

DAY = dt.date(2026, 3, 10)


def test_schemas_cover_the_load_order(spark):
    assert set(LOAD_ORDER) == set(SCHEMAS)
    assert len(StructType.fromDDL(SCHEMAS["fct_order"])) == 21


def test_mart_rebuild_replaces_and_survives_failure(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_mart(spark.range(3).toDF("a"), root, "t")
    sinks.write_mart(spark.range(5).toDF("a"), root, "t")
    assert tables.read_table(spark, root, "mart.t").count() == 5
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).alias("a"))
    with pytest.raises(Exception):
        sinks.write_mart(bad, root, "t")
    assert tables.read_table(spark, root, "mart.t").count() == 5


def test_partitioned_mart(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("month"))
    sinks.write_mart(df, str(tmp_path), "p", ["month"])
    got = tables.lookup(tables.read_table(spark, str(tmp_path), "mart.p"), "month", 1)
    assert got.count() == 33


def test_csv_round_trip(spark, tmp_path):
    schema = StructType.fromDDL("d date, x decimal(6,2), s string")
    df = table(spark, "d date, x decimal(6,2), s string", (DAY, D("1.50"), "a"))
    sinks.export(df, f"{tmp_path}/c", "csv")
    assert rows(tables.read_csv(spark, f"{tmp_path}/c", schema)) == [(DAY, D("1.50"), "a")]
    with pytest.raises(ValueError):
        sinks.export(df, f"{tmp_path}/x", "xls")


def test_bulk_append_coerces(spark, tmp_path):
    df = table(spark, "k double, ok boolean", (1.0, True), (None, False))
    target = StructType.fromDDL("k short, ok boolean")
    sinks.bulk_append(df, target, f"{tmp_path}/p")
    sinks.bulk_append(df, target, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").dtypes[0] == ("k", "smallint")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4
    sinks.bulk_append(df, target, f"{tmp_path}/c", "csv")
    text = sorted(l for f in os.listdir(f"{tmp_path}/c") if f.endswith(".csv")
                  for l in open(f"{tmp_path}/c/{f}").read().split())
    assert text == ["1,t", "\\N,f"]
    with pytest.raises(QualityError):
        sinks.bulk_append(table(spark, "k double, ok boolean", (1.5, True)), target,
                          f"{tmp_path}/p")


def test_upsert_latest_with_a_hot_key(spark):
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") % 10).alias("at"), F.col("id").alias("seq"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("note"))
    got = dicts(sinks.upsert_latest(log, "k", ["at", "seq"]), "k")
    pdf = log.toPandas().sort_values(["at", "seq"]).groupby("k").tail(1).set_index("k")
    assert {k: r["seq"] for k, r in got.items()} == pdf["seq"].to_dict()
    assert all((r["note"] is None) == (r["seq"] % 2 == 1) for r in got.values())


def test_upsert_actions_manifest_observed(spark, tmp_path):
    a, b = table(spark, "k long", (1,), (2,)), table(spark, "k long", (2,), (3,))
    assert {r.k: r.action for r in sinks.upsert_actions(a, b, "k").collect()} == {
        2: "updated", 3: "saved"}
    m = {(r.table_name, r.measure): r.value
         for r in sinks.manifest({"a": a, "b": b}, {"b": {"total": "k"}}).collect()}
    assert m == {("a", "rows"): 2, ("b", "rows"): 2, ("b", "total"): 5}
    seen = sinks.observed_write(a, f"{tmp_path}/o", {"total": "k"})
    assert seen == {"rows": 2, "total": 3}


def test_weather_payload(spark):
    payload = json.dumps({"daily": {"time": ["2026-01-01", "2026-01-02"], "mm": [0.5, None]}})
    df = table(spark, "place string, payload string", ("x", payload))
    got = tables.parse_daily_arrays(df, "payload", {"time": "date", "mm": "double"},
                                    keep=["place"])
    assert rows(got) == [("x", dt.date(2026, 1, 1), 0.5), ("x", dt.date(2026, 1, 2), None)]


def test_reference_dims(spark):
    dims = tables.reference_dims(spark, {
        "channels": [(1, "Phone", False, D("0"))],
        "school_holidays": [("x", DAY, DAY)],
        "menu": {"sized": [("Pie", "Main", D("6.50"), D("1.80"), True)],
                 "sizes": [("S", "1.00"), ("L", "2.20")],
                 "plain": [("Water", "Drink", D("2.00"), D("0.45"), True)]}})
    items = dicts(dims["items"], "item_key")
    assert {k: r["size_name"] for k, r in items.items()} == {1: "S", 2: "L", 3: None}
    assert items[2]["unit_price"] == D("14.30") and items[2]["unit_cost"] == D("3.96")


ENTRY = ("business_date date, total_orders long, gross_revenue decimal(10,2), "
         "delivery_orders long, pickup_orders long, staff_hours decimal(6,2), "
         "is_closed boolean, entered_at timestamp, seq long")


def entry(day, orders, seq, closed=False):
    return (day, orders, D(20 * orders), orders, 0, D("8"), closed,
            dt.datetime(2026, 3, 20, 0, 0, seq), seq)


def test_entry_stream(spark, tmp_path):
    """Corrections arrive in later files and out of order; blocked rows are
    dropped; other months stay as they are; a rerun changes nothing."""
    inbox, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    april = dt.date(2026, 4, 1)
    batches = [[entry(DAY, 5, 1), entry(april, 7, 2)], [entry(DAY, 9, 4), entry(DAY, 8, 3)],
               [entry(DAY, 0, 9), entry(DAY + dt.timedelta(1), 0, 10, closed=True)]]
    schema = StructType.fromDDL(ENTRY)

    def run():
        src = spark.readStream.schema(schema).parquet(inbox)
        streaming.stream_entries(src, sink, f"{tmp_path}/cp").awaitTermination()
        return {r.business_date: r.total_orders
                for r in streaming.current_entries(spark, sink).collect()}

    for i, b in enumerate(batches):
        table(spark, ENTRY, *b).write.mode("append").parquet(inbox)
        got = run()
        assert got[DAY] == [5, 9, 9][i] and got[april] == 7
    assert got[DAY + dt.timedelta(1)] == 0 and len(got) == 3
    assert run() == got


ORDER = ("order_key long, order_ts timestamp, is_delivery boolean, is_cancelled boolean, "
         "gross_amount decimal(18,2)")


def test_order_stream_does_not_depend_on_the_cut(spark, tmp_path):
    """Late and unordered orders count, however the input is cut into batches."""
    def o(k, day, hour):
        return (k, dt.datetime(2026, 3, day, hour), k % 2 == 0, False, D("10"))

    orders = [o(1, 9, 9), o(2, 1, 23), o(3, 28, 1), o(4, 1, 12), o(5, 9, 0), o(6, 2, 4), o(6, 2, 4)]
    schema, seen = StructType.fromDDL(ORDER), []
    for i, cut in enumerate([[orders], [[x] for x in orders], [orders[4:], orders[:4]]]):
        inbox, sink = f"{tmp_path}/in{i}", f"{tmp_path}/log{i}"
        for batch in cut:
            table(spark, ORDER, *batch).coalesce(1).write.mode("append").parquet(inbox)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        for _ in range(2):  # a second start finds nothing new
            streaming.stream_kpi(src, sink, f"{tmp_path}/cp{i}").awaitTermination()
        got = dicts(streaming.stream_kpi_result(spark, sink), "full_date")
        seen.append(got)
        assert {d.day: r["orders"] for d, r in got.items()} == {1: 2, 2: 2, 9: 2, 28: 1}
    assert seen[0] == seen[1] == seen[2]
    assert seen[0][dt.date(2026, 3, 1)]["delivery_orders"] == 2


def test_duplicate_orders(spark, tmp_path):
    """Copies in one file, in later files and long after are one order."""
    row = (1, dt.datetime(2026, 3, 1, 9), True, False, D("10"))
    for rows_ in [[row, row, (2, *row[1:])], [(3, dt.datetime(2026, 5, 1), *row[2:])], [row]]:
        table(spark, ORDER, *rows_).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = (spark.readStream.schema(StructType.fromDDL(ORDER)).option("maxFilesPerTrigger", 1)
           .parquet(f"{tmp_path}/in"))
    streaming.stream_orders(src, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = streaming.distinct_orders(spark, f"{tmp_path}/out")
    assert sorted(r.order_key for r in got.collect()) == [1, 2, 3] and len(got.columns) == 5


def test_entry_store(spark, tmp_path):
    store = EntryStore(spark, f"{tmp_path}/store")
    fields = ENTRY.replace(", entered_at timestamp, seq long", "")
    assert {r.action for r in store.upsert(table(spark, fields, entry(DAY, 5, 0)[:7])).collect()
            } == {"saved"}
    more = table(spark, fields, entry(DAY, 6, 0)[:7], entry(DAY + dt.timedelta(2), 4, 0)[:7],
                 entry(DAY + dt.timedelta(3), 0, 0)[:7])  # the last one is blocked
    got = {r.business_date: r.action for r in store.upsert(more).collect()}
    assert got == {DAY: "updated", DAY + dt.timedelta(2): "saved",
                   DAY + dt.timedelta(3): "blocked"}
    assert store.get(DAY).first().total_orders == 6 and store.load().count() == 2
    with pytest.raises(ValueError):
        store.upsert(table(spark, fields, entry(DAY, 1, 0)[:7], entry(DAY, 2, 0)[:7]))
    today = str(DAY + dt.timedelta(4))
    assert {r[0].day for r in store.missing_days(today).collect()} == {11, 13}
