import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom import fixed_values as V
from martloom.operators import combine, forecast, series
from martloom.operators.etl import build_calendar
from helpers import dicts, table

D0 = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def gap(spark):
    """Ten days with the fifth missing."""
    days = [i for i in range(10) if i != 4]
    return table(spark, "d date, v long", *[(D0 + dt.timedelta(i), i) for i in days])


def test_row_and_day_windows_differ_on_gaps(gap):
    rows = dicts(series.trailing_mean_rows(gap, "d", "v", 3), "d")
    days = dicts(series.trailing_mean_days(gap, "d", "v", 3), "d")
    sixth = D0 + dt.timedelta(5)
    assert rows[sixth]["trailing_mean"] == pytest.approx((2 + 3 + 5) / 3)
    assert days[sixth]["trailing_mean"] == pytest.approx((3 + 5) / 2)
    assert rows[D0]["trailing_mean"] is None and days[D0]["trailing_mean"] == 0


def test_lags(gap):
    by_day = dicts(series.with_lag_days(gap, "d", "v", 1), "d")
    by_row = dicts(series.lag_rows(gap, "d", "v", 1), "d")
    sixth = D0 + dt.timedelta(5)
    assert by_day[sixth]["v_1d_ago"] is None and by_row[sixth]["v_lag1"] == 3


def test_fill_last_rest(spark, gap):
    holes = gap.withColumn("x", F.when(F.col("v").isin(2, 7), F.col("v")))
    both = dicts(series.fill_gaps(holes, "d", ["x"], "both"), "d")
    assert both[D0]["x"] == 2 and both[D0 + dt.timedelta(9)]["x"] == 7
    assert dicts(series.fill_gaps(holes, "d", ["x"]), "d")[D0]["x"] is None
    assert series.last_n(gap, "d", 3).count() == 3
    assert series.last_n(gap, "d", 3, keep="rest").count() == 6


def test_year_to_date_restarts(spark):
    df = table(spark, "d date, v long", (dt.date(2025, 12, 31), 5), (dt.date(2026, 1, 1), 1),
               (dt.date(2026, 1, 2), 2))
    assert dicts(series.year_to_date(df, "d", "v"), "d")[dt.date(2026, 1, 2)]["ytd"] == 3


def test_period_change_zero_base(spark):
    df = table(spark, "d date, v long", (D0, 0), (D0 + dt.timedelta(7), 5),
               (D0 + dt.timedelta(14), 6))
    got = dicts(series.period_change(df, "d", "v"), "d")
    assert got[D0 + dt.timedelta(7)]["change_pct"] is None
    assert got[D0 + dt.timedelta(14)]["change_pct"] == 20.0


def test_spans_overlap_once(spark):
    cal = build_calendar(spark, "2026-01-01", "2026-01-10").select("full_date")
    spans = table(spark, "name string, start date, end date",
                  ("a", dt.date(2026, 1, 2), dt.date(2026, 1, 5)),
                  ("b", dt.date(2026, 1, 4), dt.date(2026, 1, 6)))
    got = combine.in_spans(cal, "full_date", spans)
    assert got.count() == 10 and got.filter("in_span").count() == 5


def test_replace_and_pivot(spark):
    a = table(spark, "k long, v string", (1, "old"), (2, "old"))
    b = table(spark, "k long, v string", (2, "new"), (3, "new"))
    got = dicts(combine.replace_by_key(a, b, "k"), "k")
    assert {k: r["v"] for k, r in got.items()} == {1: "old", 2: "new", 3: "new"}
    wide = dicts(combine.pivot_counts(a.unionByName(b), "k", "v", ["old", "new"]), "k")
    assert wide[2]["old"] == 1 and wide[2]["new"] == 1 and wide[3]["old"] == 0


def daily(spark, branches=1, days=140):
    """Orders = trend x weekday x rain, exactly log-linear."""
    cal = build_calendar(spark, "2026-01-01", str(D0 + dt.timedelta(days - 1)))
    u = F.unix_date("full_date")
    rain = (u * 31 % 17) * 0.6
    flags = cal.withColumn("precipitation_mm", rain).withColumn(
        "is_rainy", rain > 2.0).withColumn("temp_mean_c", (u * 13 % 25).cast("double")
        ).withColumn("is_public_holiday", u % 30 == 0).withColumn(
        "is_school_holiday", (u % 50) < 9)
    wide = flags.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
    level = F.exp(F.lit(4.0) + F.col("branch") * 0.2
                  + F.datediff("full_date", F.lit("2026-01-01").cast("date")) * 0.002
                  + F.col("day_of_week") * 0.1 + F.col("is_rainy").cast("int") * 0.1)
    return wide.withColumn("orders", level).withColumn("gross_revenue", level * 20)


def test_forecast_recovers_planted_model(spark):
    kpi = daily(spark, 3)
    frame = forecast.forecast_frame(kpi, ["branch"])
    skill = forecast.skill(frame, by=["branch"]).collect()
    assert len(skill) == 3
    assert all(r.mape < 1e-6 and r.mae < r.naive_mae for r in skill)


def test_single_series_forecast(spark):
    kpi = daily(spark, 1)
    model = forecast.fit_forecast(forecast.forecast_frame(kpi))
    beta = dict(zip(forecast.TERMS, model.first()["beta"]))
    assert beta["is_rainy"] == pytest.approx(0.1, abs=1e-4)
    last = kpi.select(F.col("full_date").alias("ds")).agg(F.max("ds").alias("ds"))
    weather = table(spark, "full_date date, temp_mean_c double, precipitation_mm double",
                    (D0 + dt.timedelta(142), 10.0, 3.0))
    none = table(spark, "holiday_date date, holiday_name string",
                 (D0 + dt.timedelta(143), "Feast"))
    spans = table(spark, "name string, start date, end date")
    fut = forecast.future_frame(last, 14, weather, none, spans)
    out = forecast.forecast_daily(model, fut, kpi).toPandas().sort_values("full_date")
    assert len(out) == 14 and (out.orders_lower <= out.orders_forecast).all()
    assert (out.orders_forecast <= out.orders_upper).all() and (out.temp_mean_c == 10.0).all()
    assert out.is_rainy.tolist().count(True) == 1 and out.is_public_holiday.sum() == 1
    assert out.revenue_forecast.astype(float).iloc[0] == pytest.approx(
        out.orders_forecast.iloc[0] * 20, abs=0.02)


def bent(spark, days=400, at=200, noise=0.1, branches=2):
    """Growth until day ``at``, decline after it, daily noise; branch 1 never bends."""
    cal = daily(spark, branches, days).drop("orders", "gross_revenue")
    t = F.datediff("full_date", F.lit("2026-01-01").cast("date"))
    slope = F.when(F.col("branch") == 0, t * 0.004 - F.greatest(t - at, F.lit(0)) * 0.008).otherwise(t * 0.001)
    u = forecast.drawn(9, F.col("branch"), F.unix_date("full_date"))
    v = forecast.drawn(10, F.col("branch"), F.unix_date("full_date"))
    normal = F.sqrt(-2 * F.log(u)) * F.cos(v * 6.283185307179586)
    return cal.withColumn("orders", F.exp(4 + slope + normal * noise)).withColumn("gross_revenue", F.lit(100.0))


def test_trend_bends_where_it_did(spark):
    frame = forecast.forecast_frame(bent(spark), ["branch"])
    got = {r.branch: r for r in forecast.fit_forecast(frame, ["branch"]).collect()}
    for branch, want in ((0, (0.004, -0.004)), (1, (0.001, 0.001))):
        r = got[branch]
        trend, bends = r.beta[1], r.beta[len(forecast.TERMS):]
        slope = lambda share: (trend + sum(b for b, k in zip(bends, r.knots) if k < share)) / r.span
        assert slope(0.2) == pytest.approx(want[0], abs=0.001) and slope(0.95) == pytest.approx(want[1], abs=0.001)
        assert r.sigma == pytest.approx(0.1, rel=0.15)
    assert got[0].bend > 3 * got[1].bend
    assert all(r.mape < 0.12 for r in forecast.backtest(frame, 28, ["branch"]).collect())


def test_penalised_fit_against_dense_algebra(spark):
    """The same fit from the rows themselves, branch by branch."""
    frame = forecast.forecast_frame(bent(spark, 120, 60), ["branch"]).filter("ds > '2026-01-03' or branch = 0")
    got = {r.branch: r for r in forecast.fit_forecast(frame, ["branch"]).collect()}
    for branch, f in frame.toPandas().sort_values("ds").groupby("branch"):
        days = np.array([d.toordinal() for d in f.ds])
        t = (days - days[0]) / (days[-1] - days[0])
        knots = np.quantile(t, [0.8 * k / 25 for k in range(1, 26)])
        dow = np.array([d.weekday() for d in f.ds])
        x = np.column_stack([np.ones(len(f)), t, f[V.FORECAST_REGRESSORS].to_numpy(float),
                             *[(dow == d).astype(float) for d in range(1, 7)],
                             *[np.maximum(t - k, 0) for k in knots]])
        y = np.log(f.y.to_numpy(float))
        hard = x[:, :13]
        rest = y - hard @ np.linalg.lstsq(hard, y, rcond=None)[0]
        noise = rest @ rest / (len(y) - 13)
        for _ in range(3):
            ridge = np.diag(np.where(np.arange(38) < 13, 0, noise / 0.005))
            beta = np.linalg.solve(x.T @ x + ridge, x.T @ y)
            noise = ((y - x @ beta) ** 2).sum() / (len(y) - np.trace(np.linalg.solve(x.T @ x + ridge, x.T @ x)))
        assert np.allclose(got[branch].beta, beta, atol=1e-6) and np.allclose(got[branch].knots, knots)
        assert got[branch].sigma == pytest.approx(np.sqrt(noise), rel=1e-6)


def test_intervals_cover_and_widen(spark):
    """Held-out days of many series lie in the 80 % interval about that often; further
    ahead the trend may have changed, so the interval is wider."""
    frame = forecast.forecast_frame(bent(spark, 200, 500, branches=12), ["branch"])
    covered = forecast.backtest(frame, 28, ["branch"]).agg(F.avg("covered")).first()[0]
    assert 0.7 < covered < 0.92
    model = forecast.fit_forecast(forecast.forecast_frame(bent(spark, 200, 100), ["branch"]), ["branch"])
    ahead = frame.filter("branch = 0").agg(F.max("ds").alias("ds")).select(
        F.explode(F.array(F.date_add("ds", 1), F.date_add("ds", 60))).alias("ds")).withColumns(
        {c: F.lit(0) for c in V.FORECAST_REGRESSORS}).withColumn("branch", F.lit(0))
    near, far = [np.log(r.yhat_upper / r.yhat_lower) for r in
                 forecast.predict(model, ahead, ["branch"]).orderBy("ds").collect()]
    assert far > 1.08 * near


def test_draws_are_uniform_and_apart(spark):
    df = spark.range(20_000).select(forecast.drawn(1, F.col("id"), 5).alias("u"), forecast.drawn(1, F.col("id"), 6).alias("v"),
                                    forecast.drawn(1, F.col("id") + 1, 5).alias("w"))
    u = df.toPandas()
    assert abs(u.u.mean() - 0.5) < 0.01 and abs(u.u.var() - 1 / 12) < 0.003 and u.u.between(0, 1).all()
    assert u.corr().abs().where(~np.eye(3, dtype=bool)).max().max() < 0.03


def test_forecast_of_odd_series(spark):
    """One day, no orders, unknown weather and a null key: no crash, no infinite bounds."""
    rows = [(None, dt.date(2026, 1, 1), 5), ("a", dt.date(2026, 1, 1), 0), ("a", dt.date(2026, 1, 2), 7),
            ("a", dt.date(2026, 1, 3), 7)]
    df = spark.createDataFrame(rows, "branch string, ds date, y long").withColumns(
        {c: F.when(F.col("ds") < "2026-01-03", 0.0) for c in V.FORECAST_REGRESSORS})
    model = forecast.fit_forecast(df, ["branch"]).collect()
    assert {r.branch for r in model} == {None, "a"} and all(np.isfinite(r.beta).all() for r in model)
    assert forecast.fit_forecast(df.limit(0), ["branch"]).count() == 0
