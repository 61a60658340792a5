"""Money, ratios and rounding."""

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"


def col(c):
    return F.col(c) if isinstance(c, str) else c


def money(c):
    return col(c).cast(MONEY)


def safe_ratio(num, den, scale=1, places=2) -> Column:
    """``num * scale / den`` rounded half-up, NULL when ``den`` is 0 or NULL.

    The division runs on decimals, so a tie such as 0.505 rounds the way SQL
    NUMERIC does instead of following the binary representation.
    """
    exact = F.try_divide(col(num).cast("decimal(22,2)") * F.lit(scale),
                         col(den).cast("decimal(22,2)"))
    return F.round(exact, places).cast("double")


def half_even(c, places=0) -> Column:
    """Banker's rounding of a double as dataframe libraries do it: scale, round
    to the nearest even integer, scale back."""
    unit = F.lit(float(10 ** places))
    return F.rint(col(c).cast("double") * unit) / unit


def clean_nan(c) -> Column:
    """NaN -> NULL, so that comparisons with NaN cannot come out true."""
    c = col(c)
    return F.when(~F.isnan(c), c)
