import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom.operators import quality as q
from helpers import dicts, rows, table

DAY = dt.date(2026, 3, 10)


def test_plausibility_edges(spark):
    m = table(spark, "a double, b double, c double, d double", (18.0, 30.0, 30.1, None))
    got = dicts(q.plausibility_gate(m, {k: (18, 30) for k in "abcd"}), "metric")
    assert {k: r["verdict"] for k, r in got.items()} == {
        "a": "PASS", "b": "PASS", "c": "FAIL", "d": "FAIL"}


def test_effect_recovery_of_planted_rain(spark):
    u = F.col("id")
    frame = spark.range(360).select(
        F.date_add(F.lit(DAY), u.cast("int")).alias("full_date"),
        (F.log(F.lit(100.0)) + (u % 7) * 0.05 + F.when(u % 4 == 0, 0.0953).otherwise(0.0)
         + (u * 7919 % 13 - 6) * 0.002).alias("log_orders"),
        (u % 4 == 0).cast("double").alias("rainy"), F.lit(0.0).alias("hot"),
        (u % 11 == 0).cast("double").alias("cold"), (u % 31 == 0).cast("double").alias("ph"),
        (u % 50 < 8).cast("double").alias("sh"), (u % 7 + 1).alias("day_of_week"),
        (u / 30 + 1).cast("int").alias("month"))
    got = dicts(q.effect_recovery(frame), "effect")
    assert got["rainy"]["recovered"] == pytest.approx(0.10, abs=0.005)
    assert got["rainy"]["verdict"] == "identified" and got["rainy"]["days"] == 360
    assert got["hot"]["recovered"] is None and got["hot"]["verdict"] == "NOT identifiable"
    first = q.demand_drivers(frame).first()
    assert first["effect"] == "rainy"


def test_keys_rules_and_require(spark):
    t = table(spark, "k long, fk long", (1, 1), (1, None), (2, 9), (3, 9))
    ref = table(spark, "id long", (1,), (2,))
    assert rows(q.check_unique(t, "k")) == [(1, 2)]
    assert rows(q.check_fk(t, "fk", ref, "id")) == [(9, 2)]
    got = dicts(q.check_rules(t, {"set": F.col("fk").isNotNull(), "pos": F.col("k") > 0}), "rule")
    assert got["set"]["violations"] == 1 and got["pos"]["violations"] == 0
    with pytest.raises(q.QualityError):
        q.require(q.check_unique(t, "k"), "duplicate keys")
    q.require(q.check_unique(ref, "id"), "duplicate keys")


def test_check_schema(spark):
    df = table(spark, "a double, b double, c string, d long", (1.0, 1.5, "t", 1), (None, 2.0, "f", 2))
    want = StructType.fromDDL("a int, b int, c boolean, e string")
    got = {r.column_name: r.issue for r in q.check_schema(df, want).collect()}
    assert set(got) == {"b", "c", "d", "e"} and "1 fractional" in got["b"]
    assert q.check_schema(df.select("a"), StructType.fromDDL("a int")).count() == 0


ENTRY = ("business_date date, total_orders long, gross_revenue decimal(10,2), "
         "delivery_orders long, pickup_orders long, staff_hours decimal(6,2), is_closed boolean")


def test_entry_rules(spark):
    d = [DAY + dt.timedelta(i) for i in range(7)]
    e = table(spark, ENTRY,
              (d[0], 0, D("0"), 0, 0, D("0"), False), (d[1], 0, D("0"), 0, 0, D("0"), True),
              (d[2], 10, D("200"), 4, 5, D("8"), False), (d[3], 10, D("50"), 5, 5, D("8"), False),
              (d[4], 10, D("600"), 5, 5, D("8"), False), (d[5], 10, D("0"), 5, 5, D("8"), False),
              (d[6], 10, D("200"), 5, 5, D("0"), False))
    got = dicts(q.entry_rules(e), "business_date")
    assert [got[x]["is_blocked"] for x in d] == [True] + [False] * 6
    assert got[d[1]]["warnings"] == [] and got[d[2]]["warnings"] == ["split_mismatch"]
    assert got[d[3]]["warnings"] == got[d[4]]["warnings"] == ["order_value_unusual"]
    assert got[d[5]]["warnings"] == ["order_value_unusual", "orders_without_revenue"]
    assert got[d[6]]["warnings"] == ["orders_without_hours"]


def test_missing_days_and_freshness(spark):
    e = table(spark, "business_date date, source string", (DAY, "history"),
              (DAY + dt.timedelta(1), "form"), (DAY + dt.timedelta(4), "form"))
    today = str(DAY + dt.timedelta(6))
    got = {r[0] for r in q.missing_days(e, today, 14).collect()}
    assert got == {DAY + dt.timedelta(i) for i in (2, 3, 5)}  # never before the first entry
    f = q.freshness(e, today).first()
    assert (f.days, f.from_history, f.from_form, f.gap_days, f.is_stale) == (3, 1, 2, 2, True)


def test_reconcile(spark):
    a = table(spark, "v decimal(8,2)", (D("1.10"),), (D("2.20"),))
    b = table(spark, "v decimal(8,2)", (D("3.30"),))
    got = dicts(q.reconcile(a, b, ["v"]), "measure")
    assert not got["rows"]["matches"] and got["v"]["matches"]
