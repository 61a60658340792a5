"""Days that are odd after weekday, month, weather and holidays are allowed for."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import half_even
from .aggregate import median_mad
from .order import number_rows
from .robust import huber_fit, with_residuals
from .stable import stable

KNOWN_DRIVERS = ("day_of_week", "is_rainy_i", "ph", "sh", "temp_mean_c")
# month belongs to demand only: the ratios have no seasonal cause
TERMS = {"orders": (*KNOWN_DRIVERS, "month"), "discount_rate": KNOWN_DRIVERS,
         "waste_pct": KNOWN_DRIVERS, "late_rate_pct": KNOWN_DRIVERS}
CATEGORICAL = {"day_of_week": range(1, 8), "month": range(1, 13)}


def anomaly_metrics(kpi: DataFrame) -> DataFrame:
    """Daily ratios and integer flags; an undefined ratio is 0."""
    def pct(num):
        ratio = F.try_divide(F.col(num).cast("double"), F.col("gross_revenue").cast("double"))
        return F.coalesce(ratio * 100, F.lit(0.0))
    return kpi.withColumns({
        "discount_rate": pct("discount_total"), "waste_pct": pct("waste_eur"),
        "is_rainy_i": F.coalesce(F.col("is_rainy").cast("int"), F.lit(0)),
        "ph": F.coalesce(F.col("is_public_holiday").cast("int"), F.lit(0)),
        "sh": F.coalesce(F.col("is_school_holiday").cast("int"), F.lit(0))})


def metric_rows(df: DataFrame, metrics: Mapping[str, Sequence[str]] = TERMS,
                keep: Sequence[str] = ("full_date", "day_name", "day_of_week")) -> DataFrame:
    """Wide to long: one row per (day, metric) with its value and terms, so
    that one job serves every metric. Days lacking the value or a term of its
    model are left out: they are not fitted and never flagged."""
    terms = sorted({t for ts in metrics.values() for t in ts} - set(keep))
    cells = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
        F.array(*[F.col(t).isNotNull() for t in ts]).alias("_known"))
        for m, ts in metrics.items()])
    long = df.select(*keep, *[F.col(t).cast("double").alias(t) for t in terms],
                     F.inline(cells))
    return long.filter(F.col("value").isNotNull() & F.forall("_known", lambda k: k)
                       ).drop("_known")


def robust_residuals(rows: DataFrame, by: Sequence[str] = (),
                     metrics: Mapping[str, Sequence[str]] = TERMS, max_iter: int = 60,
                     tol: float = 1e-8) -> DataFrame:
    """Residuals of a Huber M-estimate per series (``by`` + metric), and whether
    its iteration ``converged``. Rows of a series may be of any grain and number; only
    sums over them meet in a task."""
    series = [*by, "metric"]
    terms = list(dict.fromkeys(t for ts in metrics.values() for t in ts))
    placed = rows.withColumn("_x", _metric_design(terms, metrics))
    fitted = huber_fit(placed, series, "_x", "value", max_iter, tol)
    return with_residuals(placed, fitted, series, "_x", "value").drop("_x")


def _metric_design(terms, metrics):
    """One design for all metrics: a term that a metric's model lacks is 0 there."""
    def mine(t, c):
        of = [m for m, ts in metrics.items() if t in ts]
        return F.when(F.col("metric").isin(of), c.cast("double")).otherwise(0.0)

    cells = [F.lit(1.0)]
    for t in terms:
        levels = CATEGORICAL.get(t)
        cells += [mine(t, F.col(t))] if levels is None else [mine(t, F.col(t) == v) for v in levels]
    return F.array(*cells)


def group_mad_z(df: DataFrame, resid: str, group: Sequence[str], out: str = "z",
                noise: float = 1e-9, size: str | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD) inside a group; a group without spread falls
    back to the sample deviation, then to 1. A spread below ``noise`` times the
    group's largest ``size`` (a column; by default ``resid``) is rounding and
    counts as none. A group of a daily series has one value per day at most."""
    group = list(group)
    stats = median_mad(df, group, resid).join(df.groupBy(*group).agg(
        (F.max(F.abs(F.col(size or resid))) * noise).alias("_floor")), group)
    sd = F.when(F.col("stddev") > F.col("_floor"), F.col("stddev")).otherwise(F.lit(1.0))
    scale = F.when(F.col("mad") > F.col("_floor"), F.col("mad") * 1.4826).otherwise(sd)
    return df.join(stats, group).withColumn(
        out, (F.col(resid) - F.col("median")) / scale).drop("median", "mad", "stddev", "_floor")


def flag_anomalies(df: DataFrame, threshold: float = 3.0, by: Sequence[str] = (),
                   categories: Mapping[str, str] = V.ANOMALY_CATEGORIES) -> DataFrame:
    """Days strictly beyond the threshold, numbered by (date, metric)."""
    label = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    flagged = df.filter(F.abs("z") > threshold).select(
        *by, "full_date", "day_name", "metric",
        F.try_element_at(label, F.col("metric")).alias("category"),
        half_even("value", 2).alias("actual"), half_even("z", 2).alias("z_score"),
        F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"))
    return number_rows(flagged, ["full_date", "metric", *by], "anomaly_key")


def anomaly_daily(kpi: DataFrame, threshold: float = 3.0, by: Sequence[str] = (),
                  max_iter: int = 60) -> DataFrame:
    """Metrics, robust residuals, weekday scaling and flags in one go."""
    rows = metric_rows(anomaly_metrics(kpi), keep=(*by, "full_date", "day_name", "day_of_week"))
    # stored: the scaling reads the residuals three times, the fit runs once
    resid = stable(robust_residuals(rows, by, max_iter=max_iter), "resid")
    return flag_anomalies(group_mad_z(resid, "resid", [*by, "metric", "day_of_week"], size="value"),
                          threshold, by)


def recall_windows(flags: DataFrame, windows: DataFrame) -> DataFrame:
    """FOUND / MISSED per (name, start, end): was any day in it flagged?"""
    days = windows.select("name", F.explode(F.sequence("start", "end")).alias("full_date"))
    hits = days.join(flags.select("full_date"), "full_date").groupBy("name").agg(
        F.count(F.lit(1)).alias("flags"))
    return windows.join(hits, "name", "left").select(
        "name", "start", "end", F.coalesce("flags", F.lit(0)).alias("flags"),
        F.when(F.col("flags") > 0, "FOUND").otherwise("MISSED").alias("verdict"))
