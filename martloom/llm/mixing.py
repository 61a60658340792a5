"""Mixing sources to target weights by iterative proportional fitting (raking).
Native expressions only."""

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.stable import stable
from .text import body, words

DIMS = ("source", "lang", "topic")


def topic(c) -> Column:
    """A coarse topic of a text, by its form: table, marked, loud, short, long, prose."""
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda kept: F.length(F.regexp_replace(c, f"[^{kept}]+", "")) / n
    return (F.when(share("|") >= 0.02, "table").when(share("#*$%&") >= 0.05, "marked")
            .when(share("A-Z") >= 0.4, "loud").when(F.length(c) < 500, "short")
            .when(F.length(c) >= 5000, "long").otherwise("prose"))


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, lang, topic, ``tokens`` (words) and a ``key`` of equal rows;
    nulls in source or lang are the value ""."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), text("source"),
                       text("lang"), topic(body("text")).alias("topic"),
                       F.size(words(body("text"))).cast("long").alias("tokens"), *more)


def tempered(cells: DataFrame, dim: str, power: float, shares: dict | None = None) -> DataFrame:
    """(dim, target) for the values that occur: the given shares, or each value's
    share of the tokens to ``power``; they add up to the total of all tokens. A
    value without a given share gets 0."""
    sums = cells.groupBy(dim).agg(F.sum("t").alias("m"))
    wish = (F.coalesce(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col(dim)], F.lit(0.0))
            if shares else F.pow(F.col("m"), F.lit(power)))
    sums = stable(sums.select(dim, "m", wish.cast("double").alias("wish")), "target")
    total, wishes = sums.agg(F.sum("m"), F.sum("wish")).first()
    return sums.select(dim, (F.col("wish") * ((total or 0) / (wishes or 1))).alias("target"))


class RakingWarning(UserWarning):
    """Marginals that were not met."""


def rake(cells: DataFrame, targets: dict, rounds: int = 30, within: float = 1e-3) -> DataFrame:
    """``cells`` (the dims, ``t`` tokens) with ``w``: the weights of the same zero
    pattern whose sums over each dim meet its targets. Each round scales the
    weights to one dim after the other; it ends when every sum differs from its own
    target by ``within`` of that target at most. After ``rounds``, or three rounds in which
    the worst sum comes no nearer (a pattern of zeros can rule targets out), it ends with a
    RakingWarning that names it. The work is on cells, of which there are as many as combinations of the dims' values."""
    cells = stable(cells.withColumn("w", F.col("t").cast("double")), "cells")
    worst, best, still = None, None, 0
    for done in range(1, rounds + 1):
        for dim, target in targets.items():
            sums = cells.groupBy(dim).agg(F.sum("w").alias("m")).join(target, dim).select(
                dim, F.when(F.col("m") > 0, F.col("target") / F.col("m")).otherwise(F.lit(0.0)).alias("factor"))
            cells = cells.join(sums, dim).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        cells = stable(cells, "cells")
        # the last dim is met by construction, but for values that have no weight left
        off = None
        for dim, target in targets.items():
            one = cells.groupBy(dim).agg(F.sum("w").alias("m")).join(target, dim).select(
                F.lit(dim).alias("dim"), F.col(dim).alias("value"), "target", "m",
                F.when(F.col("target") > 0, F.abs(F.col("m") - F.col("target")) / F.col("target"))
                .otherwise(F.lit(0.0)).alias("d"))
            off = one if off is None else off.unionByName(one)
        worst = off.agg(F.max("d").alias("d"), F.max_by(F.struct("dim", "value", "target", "m"), "d").alias("at"),
                        F.count_if(F.col("d") > within).alias("n")).first() if off is not None else None
        if not worst or not worst.n:
            return cells
        still = still + 1 if best is not None and worst.d >= best * (1 - 1e-6) else 0
        best = worst.d if best is None else min(best, worst.d)
        if still == 3:
            break
    if worst:
        warnings.warn(f"raking ended after {done} rounds with {worst.n} sums further than {within:g} of their "
                      f"targets from them; the worst is {worst.at.dim} {worst.at.value!r}: {worst.at.m:g} tokens for "
                      f"{worst.at.target:g}", RakingWarning, stacklevel=2)
    return cells


def scale(cells: DataFrame, rate: float, points: int = 64) -> float:
    """The factor c with sum(t * min(1, c * w / t)) = ``rate`` * sum(t), or the
    smallest that takes all there is. Two passes over a grid of candidates; the
    sum is linear between the last two."""
    f = F.col("w") / F.col("t")
    used = cells.filter("w > 0 and t > 0")
    total, low = cells.agg(F.sum("t")).first()[0], used.agg(F.min(f)).first()[0]
    if not total or not low:
        return 0.0
    lo, hi, goal = min(rate, 1 / low), 1 / low, rate * total
    for _ in range(2):
        grid = [lo * (hi / lo) ** (i / points) for i in range(points + 1)]
        sums = used.agg(*[F.sum(F.col("t") * F.least(F.lit(1.0), f * c)) for c in grid]).first()
        up = next((i for i, s in enumerate(sums) if s >= goal), points)
        if up == 0:
            return grid[0]
        lo, hi, below, above = grid[up - 1], grid[up], sums[up - 1], sums[up]
    return hi if above <= below or above < goal else lo + (hi - lo) * (goal - below) / (above - below)


def _drawn(rows, cells, seed):
    """Adds ``weight``, ``probability`` and ``sampled`` to sized rows."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(seed)), 11) / float(1 << 53)
    p = F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(0.0))
    return (rows.join(cells, list(DIMS), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
            .withColumn("probability", p).withColumn("sampled", draw < F.col("probability")).drop("p"))


def cell_rates(rows: DataFrame, rate: float = 0.5, power: float = 0.7, shares: dict | None = None, **options) -> DataFrame:
    """The dims with ``weight`` (tokens wanted per token there is) and ``p``, the
    probability of each document of the cell."""
    cells = stable(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("t")).filter("t > 0"), "cells")
    targets = {d: stable(tempered(cells, d, power, (shares or {}).get(d)), "target") for d in DIMS}
    cells = rake(cells, targets, **options)
    c = scale(cells, rate)
    return cells.select(*DIMS, (F.col("w") / F.col("t")).alias("weight"),
                        F.least(F.lit(1.0), F.col("w") / F.col("t") * c).alias("p"))


def probabilities(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang; others are left
    out): the dims, ``tokens``, ``weight``, ``probability`` and ``sampled``.

    Expected tokens are ``rate`` of all, with the marginals that ``shares`` (a dict
    of dicts by dim) or shares to ``power`` ask for, except where a probability
    would pass 1: such documents are taken once and the rest make up for them. The
    draw is a hash of doc_id and text, so that it can be repeated; equal rows share
    it. Texts without words have no tokens to weigh and are left out of the sample.
    An empty table gives no rows.
    """
    rows = sized(docs)
    return _drawn(rows, cell_rates(rows, **options), seed)


def sample(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The sampled documents, as they were; their columns may have any names."""
    cells = cell_rates(sized(docs), **options)
    return _drawn(sized(docs, F.struct("*").alias("_row")), cells, seed).filter("sampled").select("_row.*")
