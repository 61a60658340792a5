"""Aggregates beyond a plain ``groupBy``."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .order import running_total
from .regression import attach
from .stable import stable

#: Distinct values of a group that one window may pass over at the end.
FEW = 100_000
_GRID = 1000


def group_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    probs: Sequence[float], names: Sequence[str] | None = None,
                    exact: bool = True, wide_domain: bool = False, small_domain: bool = False,
                    few: int = FEW) -> DataFrame:
    """Linearly interpolated quantiles per group; nulls do not count, a null key is a
    group of its own.

    By default a group's range is narrowed: a mergeable sketch gives bounds around the
    wanted ranks, one count says how many values lie below and between them, and what
    lies between is looked at again until ``few`` values are left. No values are sorted
    together but these. ``small_domain=True`` (minutes, scores): an aggregate buffer of
    one counter per distinct value instead, in a single pass. ``wide_domain=True``:
    positions from a distributed running count over the distinct values.
    ``exact=False`` is the approximate sketch alone.
    """
    by = list(by)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    known = df.filter(F.col(value).isNotNull())
    if not exact:
        q = F.percentile_approx(value, list(probs), 10000)
        return _spread(known.groupBy(*by).agg(q.alias("_q")), by, names)
    if small_domain:
        return _spread(known.groupBy(*by).agg(_percentile(value, probs).alias("_q")), by, names)
    if not wide_domain:
        return _narrowed(known, by, value, probs, names, few)
    counted = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_total(counted, [value], "_c", "_upto", by)
    totals = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    placed = placed.join(totals, by) if by else placed.withColumn(
        "_n", counted.agg(F.sum("_c").alias("n")).scalar())
    picks = []
    for i, p in enumerate(probs):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            picks.append(F.min(F.when(F.col("_upto") > at, F.col(value)))
                         .cast("double").alias(f"_{side}{i}"))
    edges = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, (p, n) in enumerate(zip(probs, names)):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        part = spot - F.floor(spot)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part)
                   .alias(n))
    return edges.select(*by, *out)


def _narrowed(known, by, value, probs, names, few):
    """Quantiles by narrowing each wanted rank's range, one series of (group, wanted)."""
    rows = stable(known.select(*by, F.col(value).cast("double").alias("_v")), "values")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    spot = (F.col("_n") - 1) * F.col("_p")
    wanted = stable(sizes.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p")).select(
        *by, "_i", "_n", F.floor(spot).alias("_lo"), F.ceil(spot).alias("_hi"), (spot - F.floor(spot)).alias("_part")),
        "wanted")
    keys = [*by, "_i"]
    if (wanted.agg(F.max("_n")).first()[0] or 0) <= few:
        picked = _picked(attach(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), sizes, by, "_n"), by)
        # all wanted ranks are read off one pass over a group
        at = F.col("_upto")
        lows = [F.min(F.when(at > F.floor((F.col("_n") - 1) * float(p)), F.col("_v"))) for p in probs]
        highs = [F.min(F.when(at > F.ceil((F.col("_n") - 1) * float(p)), F.col("_v"))) for p in probs]
        part = [(F.max("_n") - 1) * float(p) - F.floor((F.max("_n") - 1) * float(p)) for p in probs]
        return picked.groupBy(*by).agg(*[(lo + (hi - lo) * w).alias(n) for lo, hi, w, n in zip(lows, highs, part, names)])
    pool = rows.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(probs))])))
    while True:
        grid = F.percentile_approx("_v", [k / _GRID for k in range(_GRID + 1)], 10 * _GRID)
        told = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), grid.alias("_e"), F.min("_v").alias("_a"),
                                       F.max("_v").alias("_z"))
        ranks = attach(told, wanted, keys, "_lo", "_hi")
        # a sketch's rank is off by a tenth of a step at most
        low, high = (F.floor(F.col("_lo") / F.col("_m") * _GRID) - 1, F.ceil((F.col("_hi") + 1) / F.col("_m") * _GRID) + 1)
        bounds = stable(ranks.select(
            *keys, F.when(low < 0, F.col("_a")).otherwise(F.get("_e", low.cast("int"))).alias("_from"),
            F.when(high > _GRID, F.col("_z")).otherwise(F.get("_e", high.cast("int"))).alias("_to")), "bounds")
        placed = attach(pool, bounds, keys, "_from", "_to")
        inside = F.col("_v").between(F.col("_from"), F.col("_to"))
        counts = stable(placed.groupBy(*keys).agg(
            F.count_if(F.col("_v") < F.col("_from")).alias("_below"),
            # those that equal a bound are one value each
            F.count_if((F.col("_v") > F.col("_from")) & (F.col("_v") < F.col("_to"))).alias("_open")), "counts")
        wanted = stable(attach(wanted, counts, keys, "_below").select(
            *by, "_i", "_n", (F.col("_lo") - F.col("_below")).alias("_lo"), (F.col("_hi") - F.col("_below")).alias("_hi"),
            "_part"), "wanted")
        pool = stable(placed.filter(inside).select(*keys, "_v"), "pool")
        if counts.agg(F.max("_open")).first()[0] <= few:
            break
    ends = _picked(attach(pool.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), wanted, keys,
                          "_lo", "_hi", "_part"), keys)
    at = F.col("_upto")
    found = ends.groupBy(*keys).agg(
        F.min(F.when(at > F.col("_lo"), F.col("_v"))).alias("lo"), F.min(F.when(at > F.col("_hi"), F.col("_v"))).alias("hi"),
        F.max("_part").alias("w"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")))
                                    .alias(n) for i, n in enumerate(names)])


def _picked(counted, keys):
    """``counted`` values with the number of rows up to each, per key."""
    upto = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return counted.withColumn("_upto", F.sum("_c").over(upto))


def _percentile(value, probs):
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))


def _spread(df, by, names):
    return df.select(*by, *[F.col("_q")[i].cast("double").alias(n)
                            for i, n in enumerate(names)])


def median_mad(df: DataFrame, by: Sequence[str], value: str,
               wide_domain: bool = False, small_domain: bool = False) -> DataFrame:
    """Per group: median, median absolute deviation, sample deviation."""
    by = list(by)
    how = {"wide_domain": wide_domain, "small_domain": small_domain}
    rows = df.select(*by, value)
    med = group_quantiles(rows, by, value, [0.5], ["median"], **how)
    dev = F.abs(F.col(value) - F.col("median")).alias("_dev")
    mad = group_quantiles(attach(rows, med, by, "median").select(*by, dev), by, "_dev", [0.5], ["mad"], **how)
    sd = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.stddev_samp(value).alias("stddev"))
    return attach(attach(med, mad, by, "mad"), sd, by, "stddev").select(*by, "median", "mad", "stddev")


def share_of_total(df: DataFrame, value: str, out: str = "share",
                   by: Sequence[str] = (), scale: int = 1, places: int = 4) -> DataFrame:
    """value / total, the total being a single scalar (or one per ``by``)."""
    total = F.sum(value)
    if by:
        wide = df.join(df.groupBy(*by).agg(total.alias("_total")), list(by))
    else:
        wide = df.withColumn("_total", df.agg(total.alias("t")).scalar())
    share = F.try_divide(F.col(value).cast("decimal(22,2)") * scale,
                         F.col("_total").cast("decimal(22,2)"))
    return wide.withColumn(out, F.round(share, places).cast("double")).drop("_total")


def mean_group_count(df: DataFrame, by: Sequence[str], out: str = "mean_count") -> DataFrame:
    """Average number of rows per group."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.avg("_n").alias(out)))


def first_seen(df: DataFrame, key: str, date: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(date).alias(out))


def rate(flag):
    """Mean of a boolean, NULLs skipped."""
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("int"))


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
