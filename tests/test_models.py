"""Segments, churn, baskets, anomalies and delivery on planted data."""

import datetime as dt
import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martloom.operators import anomaly, basket, customers, delivery, robust
from martloom.operators.stable import stable
from helpers import dicts, table

D0 = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """One customer holds a third of all orders."""
    n = 1500
    return spark.range(n).select(
        F.col("id").alias("order_key"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 7919 % 60 + 1)
        .alias("customer_key"),
        F.date_add(F.lit(D0), ((F.col("id") * 31) % 200).cast("int")).alias("full_date"),
        ((F.col("id") * 17 % 4000) / 100 + 5).cast("decimal(18,2)").alias("gross_amount"),
        (F.col("id") % 4 != 0).alias("is_delivery"))


def test_rfm_against_pandas(history):
    got = customers.rfm(history).toPandas().set_index("customer_key").sort_index()
    pdf = history.toPandas()
    pdf["gross_amount"] = pdf["gross_amount"].astype(float)
    g = pdf.groupby("customer_key").agg(last=("full_date", "max"), f=("order_key", "count"),
                                        m=("gross_amount", "sum")).sort_index()
    recency = g["last"].map(lambda d: (pdf["full_date"].max() - d).days)
    edges = np.quantile(recency, [0.2, 0.4, 0.6, 0.8])
    r = 5 - sum((recency > e).astype(int) for e in edges.round(9))
    f = pd.qcut(g["f"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    m = pd.qcut(g["m"].round(2).rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got["recency_days"].tolist() == recency.tolist()
    assert got["r_score"].tolist() == r.tolist()
    assert got["f_score"].tolist() == f.tolist()
    assert got["m_score"].tolist() == m.tolist()
    summary = customers.segment_summary(customers.rfm(history)).toPandas()
    assert summary["customers"].sum() == len(g)
    assert float(summary["revenue"].sum()) == pytest.approx(g["m"].sum(), abs=0.01)


def test_segment_rules(spark):
    from martloom.functions import rfm_segment
    cases = {(5, 5): "Champion", (3, 3): "Loyal", (5, 1): "New / Promising",
             (1, 5): "At risk - was valuable", (2, 2): "Slipping away", (1, 1): "Lost",
             (3, 1): "Occasional", (3, 5): "Loyal", (4, 3): "Loyal"}
    df = table(spark, "r long, f long", *cases)
    got = {(x.r, x.f): x.s for x in df.withColumn("s", rfm_segment("r", "f")).collect()}
    assert got == cases


def test_churn_features_do_not_see_the_outcome(history):
    before = customers.churn_features(history)
    cutoff = D0 + dt.timedelta(199 - 60)
    changed = history.withColumn("gross_amount", F.when(
        F.col("full_date") > F.lit(cutoff), F.col("gross_amount") * 100).otherwise(
            F.col("gross_amount")).cast("decimal(18,2)"))
    same = [c for c in before.columns if c != "returned"]
    a = before.select(same).toPandas().sort_values("customer_key").reset_index(drop=True)
    b = customers.churn_features(changed).select(same).toPandas().sort_values(
        "customer_key").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_churn_model_learns(spark):
    feats = spark.range(800).select(
        F.col("id").alias("customer_key"), (F.col("id") % 9 + 1).alias("frequency"),
        F.lit(10).cast("decimal(18,2)").alias("monetary"), F.lit(10.0).alias("avg_order_value"),
        (F.col("id") * 37 % 100).alias("recency_days"), F.lit(200).alias("tenure_days"),
        F.lit(1.0).alias("orders_per_month"), F.lit(0.5).alias("delivery_share"),
        (F.col("id") * 37 % 100 < 50).cast("int").alias("returned"))
    scored, auc = customers.churn_model(feats, max_iter=5)
    assert auc > 0.95 and scored.count() == 800
    bands = dicts(customers.band_value(scored), "risk_band")
    assert bands["High"]["customers"] + bands["Low"]["customers"] > 700
    top = customers.winback_list(scored, 10).collect()
    assert len(top) == 10 and [r.customer_key for r in top] == sorted(r.customer_key for r in top)


def brute_rules(baskets, min_support, min_lift):
    n, single, pair = len(baskets), Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        pair.update(itertools.permutations(sorted(b), 2))
    return {(a, b): (c / n, c / single[a], c * n / (single[a] * single[b]))
            for (a, b), c in pair.items()
            if c / n >= min_support and c * n / (single[a] * single[b]) >= min_lift}


def test_pair_rules_against_brute_force(spark):
    names = [f"i{k}" for k in range(12)]
    baskets = {o: {names[(o * p + p) % 12] for p in (1, 2, 5, 7)} for o in range(100)}
    baskets[999] = set(names)  # one order holds everything, many times over
    rows = [(o, n) for o, b in baskets.items() for n in b]
    lines = table(spark, "order_key long, item_key long",
                  *[(o, names.index(n)) for o, n in rows],
                  *[(999, i % 12) for i in range(600)])
    items = table(spark, "item_key long, item_name string", *enumerate(names))
    b = basket.baskets(lines, items)
    assert b.count() == len(rows)
    want = brute_rules(baskets, 0.02, 1.05)
    got = {(r.item_a, r.item_b): (r.support, r.confidence, r.lift)
           for r in basket.pair_rules(b, 0.02, 1.05, 1000).collect()}
    assert set(got) == set(want) and want
    for k, (s, c, l) in want.items():
        assert got[k] == pytest.approx((round(s, 4), round(c, 4), round(l, 3)), abs=1e-9)
    assert {(b_, a_) for a_, b_ in got} == set(got)  # both directions
    sets = {tuple(r["items"]): r.orders for r in basket.itemsets_fpgrowth(b, 0.02).collect()
            if len(r["items"]) == 2}
    for a_, b_ in want:
        assert sets[tuple(sorted((a_, b_)))] == round(want[(a_, b_)][0] * len(baskets))


def test_support_threshold_is_inclusive(spark):
    b = table(spark, "order_key long, item_name string", *[(o, "x") for o in range(10)],
              (0, "y"))
    assert {r.item_name for r in basket.item_support(b, 0.1).collect()} == {"x", "y"}
    assert {r.item_name for r in basket.item_support(b, 0.11).collect()} == {"x"}


@pytest.fixture(scope="module")
def kpi(spark):
    """200 days with weekday and rain effects, a three-day collapse and a
    fortnight of leaking discounts."""
    u = F.col("id")
    noise = (u * 7919 % 23 - 11) / 11.0
    dow = u % 7 + 1
    orders = F.when(u.between(60, 62), 25).otherwise(
        F.round(100 + dow * 8 + F.when(u % 5 == 0, 6).otherwise(0) + noise * 4))
    discount = F.when(u.between(120, 133), 190).otherwise(F.when(dow == 2, 60).otherwise(20)
                                                          + noise * 3)
    return spark.range(200).select(
        F.date_add(F.lit(D0), u.cast("int")).alias("full_date"),
        F.concat(F.lit("d"), dow.cast("string")).alias("day_name"), dow.alias("day_of_week"),
        F.month(F.date_add(F.lit(D0), u.cast("int"))).alias("month"),
        orders.cast("long").alias("orders"), F.lit(1000.0).alias("gross_revenue"),
        discount.cast("double").alias("discount_total"), F.lit(20.0).alias("waste_eur"),
        (10 + noise).alias("late_rate_pct"), (u % 5 == 0).alias("is_rainy"),
        (u % 40 == 0).alias("is_public_holiday"), (u % 50 < 8).alias("is_school_holiday"),
        (u * 13 % 25).cast("double").alias("temp_mean_c"))


def test_planted_anomalies_are_found(spark, kpi):
    flags = anomaly.anomaly_daily(kpi)
    windows = table(spark, "name string, start date, end date",
                    ("collapse", D0 + dt.timedelta(60), D0 + dt.timedelta(62)),
                    ("leak", D0 + dt.timedelta(120), D0 + dt.timedelta(133)),
                    ("calm", D0 + dt.timedelta(20), D0 + dt.timedelta(30)))
    got = dicts(anomaly.recall_windows(flags, windows), "name")
    assert got["collapse"]["verdict"] == "FOUND" and got["leak"]["verdict"] == "FOUND"
    assert got["calm"]["verdict"] == "MISSED"
    rows = flags.orderBy("anomaly_key").collect()
    assert [r.anomaly_key for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.direction == ("high" if r.z_score > 0 else "low") for r in rows)


def test_constant_metric_flags_nothing(kpi):
    """Rounding noise in the residuals of a flat metric is no spread."""
    flat = kpi.withColumn("discount_total", F.col("gross_revenue") * 0.033)
    flags = anomaly.anomaly_daily(flat)
    assert flags.filter("metric = 'discount_rate'").count() == 0


def test_fit_says_whether_it_converged(kpi):
    rows = anomaly.metric_rows(anomaly.anomaly_metrics(kpi))
    assert anomaly.robust_residuals(rows).filter("not converged").count() == 0
    assert anomaly.robust_residuals(rows, max_iter=1).filter("not converged").count() > 0


def huber(x, y):
    """Residuals and scale by iterated weighted least squares over the rows themselves."""
    weight, before = np.ones(len(y)), np.inf
    for _ in range(200):
        root = np.sqrt(weight)
        resid = y - x @ np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
        scale = np.median(np.abs(resid)) / 0.6744897501960817
        u = np.abs(resid) / scale
        loss = np.where(u <= 1.345, u * u / 2, 1.345 * u - 1.345 ** 2 / 2).sum()
        if abs(before - loss) <= 1e-12 * max(loss, 1):
            break
        before, weight = loss, np.where(u <= 1.345, 1, 1.345 / np.maximum(u, 1.345))
    return resid, scale


def test_huber_fit_against_the_rows(spark):
    """Series of any size and scale, a redundant column, an even and an odd number of rows,
    outliers, an exact fit and a null key."""
    r, rows, want = np.random.default_rng(0), [], {}
    for g, (n, noise) in enumerate([(50, 1), (51, 0.1), (1200, 5), (700, 1e3)]):
        x = np.column_stack([np.ones(n), r.normal(size=n), r.integers(0, 2, n)])
        x = np.column_stack([x, 1 - x[:, 2]])
        y = x[:, :3] @ [3, 1.5, -2] + r.standard_t(2, n) * noise
        y[:n // 8] += 20 * noise
        key = None if g == 1 else g
        want[key] = huber(x, y)
        rows += [(key, i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(9, i, [1.0, float(i), 0.0, 1.0], 2.0 * i + 1) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, x array<double>, y double").repartition(6)
    fitted = stable(robust.huber_fit(df, ["g"], "x", "y"), "fit")
    assert {x.g: x.converged for x in fitted.collect()} == {None: True, 0: True, 2: True, 3: True, 9: True}
    got = {}
    for x in robust.with_residuals(df, fitted, ["g"], "x", "y").collect():
        got.setdefault(x.g, {})[x.i] = x.resid
    for g, (resid, scale) in want.items():
        assert np.abs([got[g][i] for i in range(len(resid))] - resid).max() < 1e-6 * scale
    assert max(map(abs, got[9].values())) < 1e-9
    assert robust.huber_fit(df.limit(0), ["g"], "x", "y").count() == 0


def test_mad_fallbacks(spark):
    df = table(spark, "g string, x double", *[("flat", 1.0)] * 3, ("flat", 5.0),
               ("lone", 7.0), ("same", 2.0), ("same", 2.0))
    got = anomaly.group_mad_z(df, "x", ["g"]).collect()
    z = {(r.g, r.x): r.z for r in got}
    assert z[("flat", 5.0)] == pytest.approx(4 / np.std([1, 1, 1, 5], ddof=1))
    assert z[("lone", 7.0)] == 0 and z[("same", 2.0)] == 0


def test_undefined_ratios_are_zero(spark):
    df = table(spark, "discount_total double, waste_eur double, gross_revenue double, "
                      "is_rainy boolean, is_public_holiday boolean, is_school_holiday boolean",
               (0.0, 3.0, 0.0, None, True, False))
    r = anomaly.anomaly_metrics(df).first()
    assert (r.discount_rate, r.waste_pct, r.is_rainy_i, r.ph) == (0.0, 0.0, 0, 1)


def test_promise_times(spark):
    z = "order_key long, zone_key long, plz string, district_name string, " \
        "distance_km decimal(5,2), actual_min int, is_late boolean"
    from decimal import Decimal as D
    rows = [(i, 1, "1", "a", D("1"), m, m > 45) for i, m in enumerate([1, 2, 3, 4, 10])]
    rows += [(10 + i, 2, "2", "b", D("2"), 45, False) for i in range(6)]
    got = dicts(delivery.promise_times(table(spark, z, *rows)), "zone_key")
    assert got[1]["p80_min"] == 5 and got[1]["recommended_promise_min"] == 10  # p80 = 5.2
    assert got[2]["recommended_promise_min"] == 45  # exactly on a step


def test_delivery_model_and_factors(spark):
    km = (F.col("id") * 37 % 10).cast("double")
    feats = ["distance_km", "noise"]
    df = spark.range(1200).select(F.col("id").alias("order_key"), km.alias("distance_km"),
                                  (F.col("id") * 13 % 7).cast("double").alias("noise"),
                                  (20 + km * 3).cast("int").alias("actual_min"))
    model, test, scores = delivery.delivery_time_model(df, feats, trees=15, step=0.3)
    s = scores.first()
    assert s.mae < 0.3 * s.naive_mae
    factors = delivery.delivery_factors(model, test, feats).orderBy("rank").collect()
    assert [f.feature for f in factors] == feats and factors[0].share_of_effect > 0.9


def test_delivery_model_of_cells_is_that_of_rows(spark):
    """Rows in the same bins are fitted once, with the result of every row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    i = F.col("id")
    feats = ["a", "b", "rare"]
    df = spark.range(6000).select(
        i.alias("order_key"), (i * 37 % 11).cast("double").alias("a"), (i % 3).cast("double").alias("b"),
        F.when(i % 50 != 0, (i % 2000 == 1).cast("double")).alias("rare"),
        (20 + i * 37 % 11 * 3 + i % 3 * 7 + i * 7919 % 5).cast("int").alias("actual_min"))
    model, test, scores = delivery.delivery_time_model(df, feats, trees=6, step=0.3)
    bins = model.stages[0]
    assert [len(s) for s in bins.getSplitsArray()] == [12, 4, 3]  # a bin for each value
    rows_ = df.fillna(float("nan"), ["rare"]).join(test.select("order_key"), "order_key", "left_anti").withColumn(
        "label", F.col("actual_min").cast("double"))
    train = bins.transform(rows_)
    cells = delivery.binned(bins, rows_, F.avg("label").alias("label"))
    n = train.count()
    assert cells.count() <= 11 * 3 * 3 and cells.agg(F.sum("weight")).first()[0] == n > 4000
    vec = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    numbers = train.repartition(3).withColumns({c: F.col(c).cast("int") for c in bins.getOutputCols()})
    plain = GBTRegressor(maxIter=6, stepSize=0.3, maxDepth=5, seed=42, maxBins=33).fit(vec.transform(numbers))
    want = {r.order_key: r.prediction for r in plain.transform(vec.transform(bins.transform(test))).collect()}
    got = {r.order_key: r.prediction for r in model.transform(test).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    # factors: each cell once, as often as it occurs
    from martloom.operators.shapley import forest_of, shapley_values
    coded = bins.transform(test).select(*[F.col(f"{f}_bin").alias(f) for f in feats])
    shap = shapley_values(coded, forest_of(model.stages[-1]), feats).collect()
    mean = {f: sum(abs(r.shap[k]) for r in shap) / len(shap) for k, f in enumerate(feats)}
    for r in delivery.delivery_factors(model, test, feats).collect():
        assert r.mean_abs_shap == pytest.approx(mean[r.feature], abs=6e-4)


def test_cut_points_of_odd_features(spark):
    df = spark.range(10000).select(
        (F.col("id") % 100).cast("double").alias("wide"), F.lit(3.0).alias("one"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 7, 1.0).otherwise(float("nan")).alias("nan"),
        (F.col("id") == 9).cast("double").alias("rare"))
    inf = float("inf")
    wide, *others = delivery.cut_points(df, df.columns)
    assert others == [[-inf, 3.0, inf], [-inf, 0.0, inf], [-inf, 1.0, inf], [-inf, 1.0, inf]]
    assert len(wide) == 33 and all(abs(q - k * 100 / 32) <= 1.1 for k, q in enumerate(wide[1:-1], 1))


def test_itemsets_of_any_size_against_brute_force(spark):
    from itertools import combinations
    names = [f"i{k}" for k in range(9)]
    held = {o: {names[(o * p + p) % 9] for p in (1, 2, 4, 5)} | ({"lone"} if o % 100 == 0 else set())
            for o in range(300)}
    held[999] = {"rare"}  # counts in the total, is in no set
    for floor in (0.01, 0.05, 0.4):
        want = {}
        for b in held.values():
            for k in range(1, len(b) + 1):
                for c in combinations(sorted(b), k):
                    want[c] = want.get(c, 0) + 1
        want = {c: n for c, n in want.items() if n / len(held) >= floor}
        b = table(spark, "order_key long, item_name string", *[(o, n) for o, ns in held.items() for n in ns])
        got = basket.itemsets_fpgrowth(b, floor).collect()
        assert {tuple(r["items"]): r.orders for r in got} == want and len(got) == len(want)


def test_itemsets_project_equal_baskets_once(spark, monkeypatch):
    """Ten times the same baskets leave as many rows to extend."""
    stored, plain = [], basket.stable
    monkeypatch.setattr(basket, "stable", lambda df, what="frame": stored.append((what, plain(df, what))) or stored[-1][1])
    sizes = []
    for copies in (1, 10):
        stored.clear()
        b = table(spark, "order_key long, item_name string",
                  *[(o + 1000 * c, f"i{o * p % 7}") for c in range(copies) for o in range(1, 40) for p in (1, 2, 3)]).distinct()
        basket.itemsets_fpgrowth(b, 0.02).collect()
        sizes.append([df.count() for what, df in stored if what == "projected"])
    assert sizes[0] == sizes[1] and sizes[0][0] <= 39
