"""Huber's M-estimate for many series at once, from sums alone.

Each step is one pass over the stored rows: tasks add up the weighted cross
products of every series and, for the scale, count absolute residuals in bins
between two bounds around each of the two middle ranks. Blocks and counts of one
series meet, never its rows. The bounds close in on the median with every step, so
scale and coefficients settle together; a settled series is left out of the next
steps. Every step is a stored table.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .regression import HELD, attach, dot, minimum_norm
from .stable import stable

HUBER_T = 1.345
MAD_TO_SIGMA = 0.6744897501960817
BINS = 256

_STATE = [("beta", T.ArrayType(T.DoubleType())), ("scale", T.DoubleType()), ("deviance", T.DoubleType()),
          ("bounds", T.ArrayType(T.DoubleType())), ("size", T.DoubleType()), ("n", T.LongType()),
          ("done", T.BooleanType()), ("converged", T.BooleanType())]


def huber_fit(rows: DataFrame, series: Sequence[str], x: str, y: str, max_iter: int = 60,
              tol: float = 1e-8) -> DataFrame:
    """(series, ``beta``, ``scale``, ``converged``) of every series of ``rows``, whose
    design ``x`` is an array of doubles; of redundant columns the smallest solution.

    Scale is the median absolute residual about zero over 0.6745. A series stops once
    scale and deviance move less than ``tol`` (relative) and the scale is known to
    that; or at once where the residuals are rounding. A null key is a series of its own.
    """
    series = list(series)
    # read once a step: as few files as their size asks for
    rows = stable(rows.select(*series, F.col(x).alias("x"), F.col(y).cast("double").alias("y")).hint("rebalance"),
                  "robust-rows")
    start = rows.groupBy(*series).agg(
        F.transform(F.first("x"), lambda _: F.lit(0.0)).alias("beta"), F.max(F.abs("y")).alias("size"),
        F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    state = stable(start.select(
        *series, "beta", none.alias("scale"), none.alias("deviance"), F.array().cast("array<double>").alias("bounds"),
        "size", "n", F.lit(False).alias("done"), F.lit(False).alias("converged")), "robust")
    for _ in range(max_iter):
        left = Observation()
        state = stable(_stepped(rows, state, series, tol).observe(left, F.count_if(~F.col("done")).alias("open")), "robust")
        if not left.get["open"]:
            break
    return state.select(*series, "beta", "scale", "converged")


def with_residuals(rows: DataFrame, fitted: DataFrame, series: Sequence[str], x: str, y: str) -> DataFrame:
    """``rows`` with ``resid`` and whether their series ``converged``."""
    out = attach(rows, fitted, list(series), "beta", "converged")
    return out.withColumn("resid", F.col(y).cast("double") - dot(x, "beta")).drop("beta")


def _stepped(rows, state, series, tol):
    """The next state of every series; only open ones are looked at."""
    joined = attach(rows, state.filter("not done"), series, "beta", "scale", "bounds")
    types = {c: to_arrow_type(rows.schema[c].dataType) for c in series}
    out = T.StructType([*[rows.schema[c] for c in series], T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches):
        held = {}
        for batch in batches:
            if not len(batch):
                continue
            design = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            value = batch.column("y").to_numpy(zero_copy_only=False)
            betas, scales, bounds = (batch.column(c) for c in ("beta", "scale", "bounds"))
            places = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in series]) if series else [()] * len(batch)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                sums = _sums(design[at], value[at], np.array(betas[at[0]].as_py()), scales[at[0]].as_py(),
                             bounds[at[0]].as_py())
                held[key] = held[key] + sums if key in held else sums
            if len(held) > HELD:
                yield flushed(held)
                held = {}
        if held:
            yield flushed(held)

    def flushed(held):
        keys = [pa.array(k, types[c]) for c, k in zip(series, zip(*held))] if series else []
        return pa.record_batch([*keys, pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))],
                               [*series, "sums"])

    cells = joined.mapInArrow(run, out).select(*series, F.posexplode("sums").alias("cell", "s"))
    cells = cells.groupBy(*series, "cell").agg(F.sum("s").alias("s"))
    kept = T.StructType([*[rows.schema[c] for c in series], *[T.StructField(n, t) for n, t in _STATE]])

    def advance(sums, before):
        [row] = before.to_dict("records")
        if not row["done"]:
            row = _advanced({**row, "sums": sums.sort_values("cell")["s"].to_numpy()}, tol)
        return pd.DataFrame([[row[f.name] for f in kept.fields]], columns=[f.name for f in kept.fields])

    keys = series or [F.lit(0)]
    return cells.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(advance, kept)


def _sums(x, y, beta, scale, bounds):
    """Weighted cross products, the deviance, and the counts of absolute residuals in
    the bins of both bounds (below, inside, above)."""
    size = np.abs(y - x @ beta)
    weight, loss = np.ones(len(y)), 0.0
    if scale:
        u = size / scale
        weight = np.where(u <= HUBER_T, 1.0, HUBER_T / np.maximum(u, HUBER_T))
        loss = np.where(u <= HUBER_T, u * u / 2, HUBER_T * u - HUBER_T ** 2 / 2).sum()
    z = np.column_stack([x, y])
    counts = [np.bincount(np.clip(np.floor((size - lo) / (hi - lo) * BINS), -1, BINS).astype(int) + 1,
                          minlength=BINS + 2) for lo, hi in zip(bounds[::2], bounds[1::2])]
    return np.concatenate([((z * weight[:, None]).T @ z).ravel(), [loss], *counts]).astype(float)


def _middle(rank, lo, hi, counts):
    """(value, bin width, next bounds) of the element with this rank."""
    width, upto = (hi - lo) / BINS, np.cumsum(counts)
    at = int(np.searchsorted(upto, rank, "right"))
    if at == 0:  # it lies below: look there
        return lo, hi - lo, (max(lo - 32 * (hi - lo), 0.0), lo + width)
    if at == BINS + 1:
        return hi, hi - lo, (hi - width, hi + 32 * (hi - lo))
    left = lo + (at - 1) * width
    value = left + width * (rank - upto[at - 1] + 0.5) / counts[at]
    return value, width, None


def _advanced(state, tol):
    """One series a step further."""
    sums, bounds = state["sums"], list(state["bounds"])
    p = len(state["beta"])
    z = sums[:(p + 1) ** 2].reshape(p + 1, p + 1)
    coef, _ = minimum_norm(z[:p, :p], z[:p, p])
    new = {**state, "beta": coef.tolist()}
    if not bounds:  # all residuals of the plain fit lie below the root of their squares
        most = float(np.sqrt(max(z[p, p] - z[:p, p] @ coef, 0.0))) * (1 + 1e-9) + 1e-9 * state["size"] + 1e-300
        return {**new, "bounds": [0.0, most] * 2}
    counts = sums[(p + 1) ** 2 + 1:].reshape(2, BINS + 2)
    n, before = int(state["n"]), state["scale"]
    before = None if before is None or np.isnan(before) else before
    found = [_middle(r, *bounds[2 * k:2 * k + 2], counts[k]) for k, r in enumerate(((n - 1) // 2, n // 2))]
    scale = (found[0][0] + found[1][0]) / 2 / MAD_TO_SIGMA
    moved = abs(scale - before) if before else scale
    around = []
    for value, width, wider in found:
        half = max(2 * width, 2 * moved * MAD_TO_SIGMA, 1e-13 * state["size"], 1e-300)
        around += wider or (max(value - half, 0.0), value + half)
    sure = all(w is None for _, _, w in found) and max(w for _, w, _ in found) <= tol * max(scale, 1e-300)
    loss = float(sums[(p + 1) ** 2])
    exact = scale <= 1e-9 * state["size"] and all(w is None for _, _, w in found)
    still = (before is not None and sure and moved <= tol * scale and state["deviance"] is not None
             and abs(loss - state["deviance"]) <= tol * max(loss, 1.0))
    if exact or still:
        return {**state, "scale": scale, "deviance": loss, "done": True, "converged": True}
    return {**new, "scale": scale or None, "deviance": loss if before else None, "bounds": around}
