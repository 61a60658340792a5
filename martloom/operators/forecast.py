"""Demand forecast for one or many daily series.

The model is log-linear: a trend that may bend, weekday factors and
calendar/weather regressors multiply. All series are fitted together from
summed normal equations. Yearly seasonality is left out, as one year of
history cannot carry it.

The trend is piecewise linear. Its slope may change at dates that are spread
evenly over the first part of the history; the changes have a normal prior
around none, so a bend appears only where the days call for it. Ahead of the
history the slope stays, but the interval allows for further changes: as often
and as large as those of the history, drawn many times.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import half_even, money, names_of
from .combine import in_spans
from .regression import attach, design, dot, known, moments, solve
from .series import fill_gaps, lag_rows, last_n

#: Columns of the design, in order, before the bends: the first weekday is the
#: intercept's.
TERMS = ("intercept", "trend", *V.FORECAST_REGRESSORS, *[f"dow={d}" for d in range(1, 7)])
#: Possible bends, the part of the history they lie in, and the deviation of a slope
#: change (in log units over the length of the history): that of a Laplace prior of
#: scale 0.05.
BENDS, BEND_SHARE, BEND_SPREAD = 25, 0.8, 0.05 * 2 ** 0.5
#: Draws of the future, so that both ends of an 80 % interval are a draw.
DRAWS = 401


def forecast_frame(kpi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ds, y and the regressors as numbers."""
    flags = ("is_rainy", "is_public_holiday", "is_school_holiday")
    return kpi.select(*by, F.col("full_date").alias("ds"), F.col("orders").alias("y"),
                      F.col("precipitation_mm").cast("double").alias("precipitation_mm"),
                      F.col("temp_mean_c").cast("double").alias("temp_mean_c"),
                      *[F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in flags])


def future_frame(last: DataFrame, horizon: int, weather: DataFrame, holidays: DataFrame,
                 spans: DataFrame, by: Sequence[str] = (), rain_mm=V.RAINY_ABOVE_MM) -> DataFrame:
    """The next ``horizon`` days of each series with weather and calendar
    flags. ``last`` holds (by..., ds); missing weather is carried forward,
    then backward."""
    ahead = last.groupBy(*by).agg(F.max("ds").alias("_last")).select(*by, F.explode(
        F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("ds"))
    named = holidays.select(F.col("holiday_date").alias("ds"), F.lit(1).alias("_ph")).distinct()
    known = weather.select(F.col("full_date").alias("ds"),
                           F.col("temp_mean_c").cast("double").alias("temp_mean_c"),
                           F.col("precipitation_mm").cast("double").alias("precipitation_mm"))
    out = in_spans(ahead.join(known, "ds", "left").join(named, "ds", "left"), "ds", spans,
                   out="_sh")
    out = out.select(
        *by, "ds", "precipitation_mm", "temp_mean_c",
        F.coalesce(F.col("precipitation_mm") > rain_mm, F.lit(False)).cast("int")
        .alias("is_rainy"),
        F.coalesce("_ph", F.lit(0)).alias("is_public_holiday"),
        F.col("_sh").cast("int").alias("is_school_holiday"))
    return fill_gaps(out, "ds", ["precipitation_mm", "temp_mean_c"], "both", by)


def trend_frame(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per series: ``first`` day, ``span`` in days, and the ``knots`` where the trend
    may bend, as shares of the span at even quantiles of the days."""
    day = F.unix_date("ds")
    probs = F.array(*[F.lit(BEND_SHARE * k / BENDS) for k in range(1, BENDS + 1)])
    told = train.groupBy(*by).agg(F.min("ds").alias("first"), F.greatest(F.max(day) - F.min(day), F.lit(1)).alias("span"),
                                  F.percentile(day, probs).alias("_q"))
    return told.withColumn("knots", F.transform(
        "_q", lambda q: (q - F.unix_date("first")) / F.col("span"))).drop("_q")


def _designed(frame: DataFrame) -> DataFrame:
    """``x`` of every row; ``frame`` has the columns of :func:`trend_frame`."""
    t = F.datediff("ds", "first") / F.col("span")
    plain = design([t, *V.FORECAST_REGRESSORS], {"_dow": range(1, 7)})
    bends = F.transform("knots", lambda k: F.greatest(t - k, F.lit(0.0)))
    return (frame.withColumn("_dow", F.weekday("ds")).withColumn("x", F.concat(plain, bends)).drop("_dow"))


def fit_forecast(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per series: ``beta`` (terms, then bends), the residual deviation on the
    log scale ``sigma``, the ``bend`` (mean size of a slope change), and where the
    trend starts and bends. Days without orders or with an unknown regressor do not
    count."""
    by = list(by)
    days = frame.filter((F.col("y") > 0) & ~F.exists(
        F.array(*[F.col(c).cast("double") for c in V.FORECAST_REGRESSORS]), lambda v: v.isNull() | F.isnan(v)))
    place = trend_frame(days, by)
    train = _designed(attach(days, place, by, "first", "span", "knots")).withColumn(
        "log_y", F.log(F.col("y").cast("double")))
    fitted = solve(moments(train, by, "x", "log_y"), by, len(TERMS), BEND_SPREAD)
    free = F.greatest(F.col("n") - F.col("used"), F.lit(1.0))
    changes = F.slice("beta", len(TERMS) + 1, BENDS)
    told = fitted.select(*by, "beta", F.sqrt(F.col("rss") / free).alias("sigma"), F.aggregate(
        changes, F.lit(0.0), lambda s, d: s + F.abs(d), lambda s: s / BENDS).alias("bend"))
    return attach(told, place, by, "first", "span", "knots")


def drawn(*parts) -> Column:
    """A uniform draw in (0, 1) that depends on its integer ``parts`` alone."""
    def mixed(x, p):  # products stay inside 64 bits
        x = ((x + p + 1) * 1103515245) % 4294967296
        x = (x.bitwiseXOR(F.shiftright(x, 15)) * 1812433253) % 4294967296
        return x.bitwiseXOR(F.shiftright(x, 16))

    of = F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts])
    return (F.aggregate(of, F.lit(0).cast("long"), mixed) + 0.5) / 4294967296.0


def future_logs(ahead: Column, seed: int = 1) -> Column:
    """Deviations from the fitted curve ``ahead`` days after the history, one per draw:
    slope changes of the days between, Laplace-distributed with mean size ``bend``
    and as frequent as the possible bends of the history, and the day's own noise."""
    rate = F.lit(float(BENDS)) / (F.col("span") * BEND_SHARE)

    def change(m, j):
        size = F.log(drawn(seed, 2, m, j)) * F.col("bend") * F.when(drawn(seed, 3, m, j) < 0.5, 1.0).otherwise(-1.0)
        return F.when(drawn(seed, 1, m, j) < rate, size * (ahead - j) / F.col("span")).otherwise(0.0)

    def one(m):
        bent = F.aggregate(F.filter(F.sequence(F.lit(1), F.greatest(ahead, F.lit(1))), lambda j: j < ahead),
                           F.lit(0.0), lambda s, j: s + change(m, j))
        noise = F.sqrt(-2 * F.log(drawn(seed, 4, m, ahead))) * F.cos(drawn(seed, 5, m, ahead) * 6.283185307179586)
        return bent + noise * F.col("sigma")

    return F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), one)


def predict(model: DataFrame, frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """yhat with its 80 % interval for every row of ``frame``. Inside the history the
    interval is that of a day's noise."""
    out = _designed(attach(frame, model, list(by), "beta", "sigma", "bend", "first", "span", "knots"))
    ahead = F.greatest(F.datediff("ds", "first") - F.col("span"), F.lit(0)).cast("int")
    out = (out.withColumn("_log", dot("x", "beta")).withColumn("_ahead", ahead)
           .withColumn("_draws", F.array_sort(future_logs(F.col("_ahead")))))
    low, high = (F.element_at("_draws", int(q * (DRAWS - 1)) + 1) for q in (0.1, 0.9))
    return (out.withColumn("yhat", F.exp("_log"))
            .withColumn("yhat_lower", F.exp(F.col("_log") + low))
            .withColumn("yhat_upper", F.exp(F.col("_log") + high))
            .drop("_log", "_ahead", "_draws", "beta", "sigma", "bend", "first", "span", "knots", "x"))


def backtest(frame: DataFrame, holdout: int = 28, by: Sequence[str] = ()) -> DataFrame:
    """Fit without the last ``holdout`` rows of each series, score on them;
    ``covered`` is the share of these days inside their interval."""
    train = last_n(frame, "ds", holdout, by, keep="rest")
    test = last_n(frame, "ds", holdout, by)
    error = F.abs(F.col("yhat") - F.col("y"))
    return predict(fit_forecast(train, by), test, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg(error).alias("mae"),
        F.avg(F.try_divide(error, F.col("y").cast("double"))).alias("mape"),
        F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double")).alias("covered"))


def naive_baseline(frame: DataFrame, lag: int = 7, holdout: int = 28,
                   by: Sequence[str] = ()) -> DataFrame:
    """Error of repeating the value ``lag`` rows (not days) earlier."""
    lagged = lag_rows(frame, "ds", "y", lag, by, "_then")
    return last_n(lagged, "ds", holdout, by).groupBy(*by).agg(
        F.avg(F.abs(F.col("y") - F.col("_then"))).alias("naive_mae"))


def skill(frame: DataFrame, holdout: int = 28, lag: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Model error against the naive baseline, per series."""
    mine, naive = backtest(frame, holdout, by), naive_baseline(frame, lag, holdout, by)
    both = (mine.join(naive, list(by)) if by
            else mine.withColumn("naive_mae", naive.scalar()))
    return both.withColumn("improvement", 1 - F.try_divide("mae", "naive_mae"))


def forecast_daily(model: DataFrame, future: DataFrame, kpi: DataFrame, aov_days: int = 28,
                   by: Sequence[str] = ()) -> DataFrame:
    """Integer forecast per day with bounds, weather and revenue at the order
    value of the last ``aov_days`` rows."""
    recent = last_n(kpi, "full_date", aov_days, by).groupBy(*by).agg(
        (F.sum("gross_revenue").cast("double") / F.sum("orders")).alias("_aov"))
    days = attach(predict(model, future, by), recent, list(by), "_aov")
    whole = half_even("yhat").cast("long")
    return days.select(
        *by, F.col("ds").alias("full_date"),
        names_of(F.weekday("ds") + 1, V.DAYS_EN).alias("day_name"),
        whole.alias("orders_forecast"),
        half_even(F.greatest(F.col("yhat_lower"), F.lit(0.0)), 0).cast("long")
        .alias("orders_lower"),
        half_even("yhat_upper", 0).cast("long").alias("orders_upper"),
        half_even("temp_mean_c", 1).alias("temp_mean_c"),
        half_even("precipitation_mm", 1).alias("precipitation_mm"),
        F.col("is_rainy").cast("boolean").alias("is_rainy"),
        F.col("is_public_holiday").cast("boolean").alias("is_public_holiday"),
        money(half_even(whole * F.col("_aov"), 2)).alias("revenue_forecast"))
