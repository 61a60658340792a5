"""Hand-written star: pickups, a cancelled order, a day without costs, a day
without orders, a customer without orders."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martloom.operators import etl
from martloom.plans import marts, reports
from helpers import dicts, table

ORDERS = ("order_key long, date_key int, customer_key long, channel_key long, zone_key long, "
          "is_delivery boolean, is_cancelled boolean, is_late boolean, actual_min int, "
          "item_qty long, gross_amount decimal(18,2), discount_amount decimal(18,2), "
          "delivery_fee decimal(18,2), commission_amount decimal(18,2), "
          "net_revenue decimal(18,2), food_cost decimal(18,2), promo_code string")


def order(k, day, cust, ch, zone, gross, late=None, minutes=None, cancelled=False, disc="0.00",
          fee="0.00", comm="0.00", food="3.00"):
    net = D(gross) - D(disc) + D(fee) - D(comm)
    return (k, day, cust, ch, zone, zone is not None, cancelled, late, minutes, 2, D(gross),
            D(disc), D(fee), D(comm), net, D(food), None)


@pytest.fixture(scope="module")
def star(spark):
    orders = table(
        spark, ORDERS,
        order(1, 20260302, 1, 1, 1, "20.00", False, 40),
        order(2, 20260302, 1, 4, 2, "30.00", True, 50, comm="3.90", fee="1.50"),
        order(3, 20260302, 2, 5, None, "10.01"),
        order(4, 20260303, 2, 1, 1, "25.00", True, 46, cancelled=True, disc="5.00"),
        order(5, 20260305, None, 5, None, "12.00"),
        order(6, 20260305, 1, 5, None, "0.00", food="0.00"))
    calendar = etl.with_weather(
        etl.with_holidays(
            etl.build_calendar(spark, "2026-03-01", "2026-03-06"),
            table(spark, "holiday_date date, holiday_name string",
                  (dt.date(2026, 3, 3), "Feast")),
            table(spark, "name string, start date, end date",
                  ("spring", dt.date(2026, 3, 5), dt.date(2026, 3, 6)))),
        table(spark, "full_date date, temp_mean_c double, precipitation_mm double",
              (dt.date(2026, 3, 1), None, float("nan")),
              (dt.date(2026, 3, 2), 4.0, 2.5), (dt.date(2026, 3, 3), None, None),
              (dt.date(2026, 3, 4), 9.0, 2.0)))
    shifts = table(
        spark, "date_key int, kitchen_hours decimal(6,2), driver_hours decimal(6,2), "
               "labour_cost decimal(8,2), waste_eur decimal(8,2), packaging_cost decimal(8,2), "
               "payment_fees decimal(8,2), fixed_cost decimal(8,2), royalty_cost decimal(8,2)",
        (20260302, D("2.00"), D("0.00"), D("10.00"), D("1.00"), D("2.00"), D("0.50"),
         D("5.00"), D("3.00")))
    return orders, shifts, calendar


def test_calendar_weather_and_flags(star):
    cal = dicts(star[2], "full_date")
    first, second = cal[dt.date(2026, 3, 1)], cal[dt.date(2026, 3, 2)]
    assert first["is_rainy"] is False and first["temp_mean_c"] is None  # NaN is not rain
    assert second["is_rainy"] and second["is_cold"] and second["day_name_de"] == "Montag"
    third = cal[dt.date(2026, 3, 3)]
    assert third["temp_mean_c"] == 4.0 and third["is_public_holiday"]  # carried forward
    assert cal[dt.date(2026, 3, 4)]["is_rainy"] is False  # 2.0 mm is not above 2.0
    assert cal[dt.date(2026, 3, 6)]["is_school_holiday"]
    assert cal[dt.date(2026, 3, 6)]["precipitation_mm"] is None  # beyond the weather table


def test_kpi_daily(star):
    k = dicts(marts.kpi_daily(*star), "date_key")
    assert set(k) == {20260302, 20260303, 20260305}  # days without orders vanish
    d = k[20260302]
    assert (d["orders"], d["delivery_orders"], d["pickup_orders"]) == (3, 2, 1)
    assert d["gross_revenue"] == D("60.01") and d["net_revenue"] == D("57.61")
    assert d["contribution_margin"] == D("57.61") - 9 - 10 - 1 - 2 - D("0.5")
    assert d["operating_profit"] == d["contribution_margin"] - 8
    assert d["avg_order_value"] == 20.0 and d["avg_delivery_min"] == 45.0
    assert d["late_rate_pct"] == 50.0 and d["delivery_share_pct"] == 66.7
    assert d["labour_cost_pct"] == 16.7  # of gross
    assert d["orders_per_kitchen_hour"] == 1.5 and d["orders_per_driver_hour"] is None
    e = k[20260303]
    assert e["labour_cost"] == 0 and e["kitchen_hours"] is None and e["cancelled_orders"] == 1
    assert k[20260305]["late_rate_pct"] is None and k[20260305]["avg_delivery_min"] is None


def test_cancelled_can_be_left_out(star):
    k = dicts(marts.kpi_daily(*star, exclude_cancelled=True), "date_key")
    assert 20260303 not in k


def test_branch_keys(star):
    orders, shifts, cal = star
    two = orders.withColumn("branch", F.lit("a")).unionByName(
        orders.withColumn("branch", F.lit("b")))
    k = marts.kpi_daily(two, shifts.withColumn("branch", F.lit("a")), cal, by=["branch"])
    got = {(r.branch, r.date_key): r for r in k.collect()}
    assert len(got) == 6
    assert got[("a", 20260302)].labour_cost == 10 and got[("b", 20260302)].labour_cost == 0


def test_zone_channel_customer(spark, star):
    orders, _, cal = star
    zones = table(spark, "zone_key long, plz string, district_name string, "
                         "distance_km decimal(5,2), base_drive_min decimal(5,2), "
                         "delivery_fee decimal(5,2)",
                  (1, "10001", "Near", D("1.20"), D("5"), D("0")),
                  (2, "10002", "Far", D("9.50"), D("24"), D("1.5")))
    z = dicts(marts.kpi_zone(orders, zones), "zone_key")
    assert z[1]["orders"] == 2 and z[1]["late_rate_pct"] == 50.0
    assert z[1]["margin_per_drive_minute"] == pytest.approx(34 / 86, abs=6e-4)
    assert z[2]["zone_label"] == "10002 Far"
    customers = table(spark, "customer_key long, customer_code string, zone_key long, "
                             "signup_channel string", (1, "C1", 1, "Web"), (9, "C9", 2, "App"))
    base = dicts(marts.customer_base(etl.with_first_order(customers, orders, cal), orders, cal),
                 "customer_key")
    assert base[1]["total_orders"] == 3 and base[1]["total_spend"] == D("50.00")
    assert base[1]["first_order_date"] == dt.date(2026, 3, 2)
    assert base[9]["total_orders"] == 0 and base[9]["total_spend"] is None
    assert base[9]["last_order_date"] is None


def test_items(spark):
    items = table(spark, "item_key long, item_name string, category string, size_name string, "
                         "unit_price decimal(6,2), unit_cost decimal(6,2), is_vegetarian boolean",
                  (1, "Soup", "Starter", None, D("4.00"), D("1.00"), True),
                  (2, "Pie", "Main", "Large", D("0.00"), D("1.00"), False))
    d = dicts(marts.mart_dim_item(items), "item_key")
    assert d[1]["item_full_name"] == "Soup" and d[1]["size_name"] == "-"
    assert d[1]["unit_margin_pct"] == 75.0
    assert d[2]["item_full_name"] == "Pie (Large)" and d[2]["unit_margin_pct"] is None
    lines = table(spark, "order_key long, item_key long, quantity long, "
                         "line_revenue decimal(8,2), line_cost decimal(8,2)",
                  (1, 1, 2, D("8.00"), D("2.00")), (1, 1, 1, D("4.00"), D("1.00")),
                  (2, 1, 1, D("4.00"), D("1.00")))
    k = dicts(marts.kpi_item(lines, items), "item_key")
    assert k[1]["orders_containing"] == 2 and k[1]["units_sold"] == 4 and len(k) == 1


def test_daily_actuals_history_wins(spark, star):
    kpi = marts.kpi_daily(*star)
    entries = table(
        spark, "business_date date, total_orders long, gross_revenue decimal(10,2), "
               "delivery_orders long, pickup_orders long, waste_eur decimal(10,2), "
               "staff_hours decimal(6,2), driver_hours decimal(6,2), is_closed boolean",
        (dt.date(2026, 3, 2), 99, D("1.00"), 0, 99, D("0"), D("1"), D("1"), False),
        (dt.date(2026, 3, 9), 3, D("40.00"), 1, 2, D("0"), D("1"), D("1"), False),
        (dt.date(2026, 3, 10), 0, D("0.00"), 0, 0, D("0"), D("0"), D("0"), True))
    a = dicts(marts.daily_actuals(kpi, entries), "business_date")
    assert len(a) == 5 and a[dt.date(2026, 3, 2)]["source"] == "history"
    assert a[dt.date(2026, 3, 9)]["avg_order_value"] == 13.33
    assert a[dt.date(2026, 3, 9)]["operating_profit"] is None
    assert a[dt.date(2026, 3, 10)]["avg_order_value"] is None


def test_pnl_adds_up(star):
    p = dicts(reports.pnl_lines(marts.kpi_daily(*star)), "line")
    total = p.pop("= Operating profit")
    assert sum(r["eur"] for r in p.values()) == total["eur"]
    assert p["Net revenue"]["pct_of_net_revenue"] == 100.0


def test_costs(spark):
    fixed = table(spark, "cost_item string, monthly_eur decimal(10,2), note string",
                  ("Rent", D("3650.00"), "n"))
    variable = table(spark, "cost_item string, rate decimal(6,4), base string, note string",
                     ("Box", D("0.0350"), "gross", "b"), ("Card", D("0.0160"), "cashless", "c"),
                     ("Fee", D("0.0500"), "net", "f"))
    a = etl.cost_table(fixed, variable)
    assert dicts(marts.mart_cost_assumption(a), "cost_item")["Rent"]["annual_eur"] == D("43800.00")
    orders = table(spark, "date_key int, gross_amount decimal(18,2), net_revenue decimal(18,2)",
                   (1, D("100.00"), D("90.00")), (1, D("100.00"), D("110.00")))
    hours = table(spark, "date_key int, kitchen_hours decimal(6,2), driver_hours decimal(6,2), "
                         "waste_eur decimal(8,2)", (1, D("10"), D("2"), D("4")))
    c = etl.daily_costs(orders, hours, a, roles={"Box": "packaging", "Card": "payment",
                                                 "Fee": "royalty"}).first()
    assert (c.labour_cost, c.packaging_cost, c.payment_fees, c.fixed_cost, c.royalty_cost) == (
        D("185.00"), D("7.00"), D("2.24"), D("120.00"), D("10.00"))
