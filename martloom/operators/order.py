"""Distributed order: global ranks, running totals, row numbers, top-k.

None of these sends the whole input through one task. Rows are placed by
range on (group, order columns, tie-break); each partition numbers its own
rows and a table with one row per (partition, group) carries the offsets.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import col
from .regression import attach
from .stable import stable


def _placed(df: DataFrame, keys) -> DataFrame:
    return stable(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_at", 33)), "placed")


def running_total(df: DataFrame, order: Sequence, weight, out: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order`` inside each ``by``
    group. ``order`` must be a total order."""
    by = list(by)
    placed = _placed(df.withColumn("_w", col(weight)),
                     [*map(F.col, by), *map(col, order)])
    sums = placed.groupBy("_part", *by).agg(F.sum("_w").alias("_w"))
    # one row per (range partition, group)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", *by, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_part", *by).orderBy("_at").rowsBetween(
        W.unboundedPreceding, 0)
    return (_on(placed.withColumn("_in", F.sum("_w").over(inside)), offsets, by)
            .withColumn(out, F.col("_off") + F.col("_in"))
            .drop("_at", "_part", "_w", "_in", "_off"))


def _on(placed, offsets, by):
    offsets = offsets.select(F.col("_part").alias("_p2"),
                             *[F.col(b).alias(f"_{b}2") for b in by], "_off",
                             *([] if "_first" not in offsets.columns else ["_first"]))
    cond = F.col("_part") == F.col("_p2")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_{b}2"))
    return placed.join(offsets, cond).drop("_p2", *[f"_{b}2" for b in by])


def global_rank(df: DataFrame, order: Sequence, out: str = "rank",
                by: Sequence[str] = ()) -> DataFrame:
    """1-based exact position of each row in ``order`` inside its group.

    Ties must be broken by the order columns themselves (append a key).
    """
    by = list(by)
    placed = _placed(df, [*map(F.col, by), *map(col, order)])
    sizes = placed.groupBy("_part", *by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", *by, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (_on(placed, offsets, by)
            .withColumn(out, F.col("_off") + F.col("_at") - F.col("_first") + 1)
            .drop("_at", "_part", "_first", "_off"))


def surrogate_keys(df: DataFrame, order: Sequence[str], out: str,
                   chunk: int = 100_000) -> DataFrame:
    """1-based key in the order of ``order``, which lists every column.

    Rows may repeat exactly. Copies are counted before they are placed (a
    range cannot be cut inside equal rows), positions come from the running
    count, and copies are written out again at the end, in chunks of at most
    ``chunk`` that travel to different tasks.
    """
    if set(order) != set(df.columns):
        raise ValueError("order must list every column")
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_total(counted, order, "_c", "_upto").withColumn(
        "_from", F.col("_upto") - F.col("_c"))
    start = F.col("_from") + F.col("_chunk") * chunk
    chunks = (placed.withColumn("_chunk", F.explode(F.sequence(
                  F.lit(0), F.floor((F.col("_c") - 1) / chunk).cast("int"))))
              .withColumn("_to", F.least(start + chunk, F.col("_upto")))
              .withColumn("_from", start).repartition("_from"))
    return chunks.select(F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias(out),
                         *df.columns)


def number_rows(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """Dense surrogate key 1..n after sorting; the key comes first."""
    ranked = global_rank(df, order, out)
    return ranked.select(out, *[c for c in df.columns])


def top_k(df: DataFrame, order: Sequence, k: int, number: str | None = None) -> DataFrame:
    """The first ``k`` rows of a total order, optionally numbered 1..k."""
    best = df.orderBy(*map(col, order)).limit(k)
    if number is None:
        return best
    # at most k rows reach this window
    return best.select(F.row_number().over(W.orderBy(*map(col, order))).alias(number),
                       *df.columns)


def latest_entries(df: DataFrame, date: str, n: int) -> DataFrame:
    return top_k(df, [F.col(date).desc()], n)


def sort_rows(df: DataFrame, *order) -> DataFrame:
    """Total sort; Spark range-partitions it."""
    return df.orderBy(*map(col, order))


def value_quintile(df: DataFrame, value: str, out: str, reverse: bool = False,
                   by: Sequence[str] = (), buckets: int = 5, small_domain: bool = False) -> DataFrame:
    """Quantile bucket of a value: 1 + number of inner edges below it.

    Edges interpolate linearly; repeated edges merge their buckets instead of
    failing. ``small_domain`` (days, minutes) finds the edges with one counter per
    distinct value.
    """
    from .aggregate import group_quantiles  # it builds on this module

    names = [f"_edge{i}" for i in range(1, buckets)]
    edges = group_quantiles(df, by, value, [round(i / buckets, 10) for i in range(1, buckets)], names,
                            small_domain=small_domain)
    wide = attach(df, edges, by, *names)
    below = sum((F.when(F.round(e, 9) < F.col(value), 1).otherwise(0) for e in names), F.lit(0))
    bucket = (F.lit(buckets) - below) if reverse else (below + 1)
    return wide.withColumn(out, F.when(F.col(value).isNotNull(), bucket.cast("int"))).drop(*names)


def rank_quintile(df: DataFrame, value: str, tiebreak: Sequence[str], out: str,
                  by: Sequence[str] = (), buckets: int = 5) -> DataFrame:
    """Quantile bucket of a row's position; ties are broken by ``tiebreak``.

    Bucket edges sit at 1 + (n-1)k/buckets and are right-closed, which is not
    the split NTILE makes. A lone row scores 1.
    """
    ranked = global_rank(df, [value, *tiebreak], "_rank", by)
    if by:
        ranked = ranked.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by))
    else:
        ranked = ranked.withColumn("_n", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    spot = F.ceil(F.try_divide((F.col("_rank") - 1) * buckets, F.col("_n") - 1))
    return (ranked.withColumn(out, F.greatest(F.lit(1), F.coalesce(spot, F.lit(1)))
                              .cast("int")).drop("_rank", "_n"))
