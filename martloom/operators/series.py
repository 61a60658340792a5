"""Operators over dated series.

Input is at day grain: one row per (series, date), so a series never holds
more rows than the calendar has days and a window per series is bounded.
``by`` names the series keys (branch, metric, ...).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F



def _w(order, by):
    return W.partitionBy(*by).orderBy(*([order] if not isinstance(order, (list, tuple))
                                        else order))


def trailing_mean_rows(df: DataFrame, order: str, value: str, n: int = 7,
                       by: Sequence[str] = (), out: str = "trailing_mean") -> DataFrame:
    """Mean of this row and the n-1 before it; NULL until n values exist."""
    frame = _w(order, by).rowsBetween(1 - n, 0)
    full = F.count(value).over(frame) == n
    return df.withColumn(out, F.when(full, F.avg(value).over(frame)))


def trailing_mean_days(df: DataFrame, date: str, value: str, n: int = 7,
                       by: Sequence[str] = (), out: str = "trailing_mean") -> DataFrame:
    """Mean over the n calendar days ending here, counting days that have data."""
    frame = _w(F.unix_date(date), by).rangeBetween(1 - n, 0)
    return df.withColumn(out, F.avg(value).over(frame))


def year_to_date(df: DataFrame, date: str, value: str, by: Sequence[str] = (),
                 out: str = "ytd") -> DataFrame:
    frame = W.partitionBy(*by, F.year(date)).orderBy(date).rowsBetween(
        W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(frame))


def fill_gaps(df: DataFrame, order: str, cols: Sequence[str],
              direction: str = "forward", by: Sequence[str] = ()) -> DataFrame:
    """Carry the last known value forward, backward, or forward then backward."""
    ahead = _w(order, by).rowsBetween(W.unboundedPreceding, 0)
    behind = _w(order, by).rowsBetween(0, W.unboundedFollowing)
    if direction not in ("forward", "backward", "both"):
        raise ValueError(direction)
    new = {}
    for c in cols:
        last = F.last(c, ignorenulls=True).over(ahead)
        first = F.first(c, ignorenulls=True).over(behind)
        new[c] = {"forward": last, "backward": first,
                  "both": F.coalesce(last, first)}[direction]
    return df.withColumns(new)


def with_lag_days(df: DataFrame, date: str, value: str, days: int = 7,
                  by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The value ``days`` calendar days earlier, NULL when that day is absent."""
    out = out or f"{value}_{days}d_ago"
    earlier = df.select(*by, F.date_add(date, days).alias(date), F.col(value).alias(out))
    return df.join(earlier, [*by, date], "left")


def period_change(df: DataFrame, date: str, value: str, days: int = 7,
                  by: Sequence[str] = (), out: str = "change_pct") -> DataFrame:
    """Percent change against the same day ``days`` earlier."""
    before = f"{value}_{days}d_ago"
    lagged = with_lag_days(df, date, value, days, by, before)
    change = F.try_divide((F.col(value) - F.col(before)).cast("decimal(22,2)") * 100,
                          F.col(before).cast("decimal(22,2)"))
    return lagged.withColumn(out, F.round(change, 1).cast("double"))


def lag_rows(df: DataFrame, order: str, value: str, n: int,
             by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The value ``n`` rows earlier, whatever the dates in between."""
    return df.withColumn(out or f"{value}_lag{n}",
                         F.lag(value, n).over(_w(order, by)))


def last_n(df: DataFrame, order: str, n: int, by: Sequence[str] = (),
           keep: str = "last") -> DataFrame:
    """The last ``n`` rows of every series, or (``keep='rest'``) all others."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc()))
    numbered = df.withColumn("_back", place)
    wanted = F.col("_back") <= n if keep == "last" else F.col("_back") > n
    return numbered.filter(wanted).drop("_back")


def with_group_stat(df: DataFrame, by: Sequence[str], **stats) -> DataFrame:
    """Aggregate per group and put the result back on every row."""
    table = df.groupBy(*by).agg(*[s.alias(n) for n, s in stats.items()])
    return df.join(table, list(by), "left")


def in_period(df: DataFrame, date: str, lo, hi, month_key: str | None = None) -> DataFrame:
    """Inclusive date range. ``month_key`` names a yyyymm partition column, so
    that only the months of the range are listed and read."""
    out = df.filter(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    if month_key:
        ends = [F.date_format(F.lit(d).cast("date"), "yyyyMM").cast("int") for d in (lo, hi)]
        out = out.filter(F.col(month_key).between(*ends))
    return out


def temporal_split(df: DataFrame, date: str, outcome_days: int = 60):
    """(observation rows, outcome rows) around ``max(date) - outcome_days``."""
    cut = df.agg(F.date_sub(F.max(date), outcome_days).alias("c")).scalar()
    return df.filter(F.col(date) <= cut), df.filter(F.col(date) > cut)
