"""Least squares for many series at once.

A row's design is an array of doubles in a fixed order of columns. Tasks add the
cross products of their rows up, one block per series, and only these blocks, cell
by cell, are shuffled and summed. A solve sees the p x p block of one series, never
its rows.
"""

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Blocks that a task holds before it hands them on.
HELD = 2_000


def design(numeric: Sequence[str | Column], levels: Mapping[str, Sequence] | None = None) -> Column:
    """Intercept, the numeric columns, then a dummy per level of each categorical
    column; list all levels but one where the solution has to be unique."""
    cells = [F.lit(1.0), *[(F.col(c) if isinstance(c, str) else c).cast("double") for c in numeric]]
    for name, values in (levels or {}).items():
        cells += [F.when(F.col(name).isNull(), None).otherwise((F.col(name) == v).cast("double")) for v in values]
    return F.array(*cells)


def known(x: str) -> Column:
    """Whether every cell of a design is a number."""
    return ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def dot(x, beta) -> Column:
    """Fitted value of a row."""
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def moments(df: DataFrame, series: Sequence[str], x: str, y: str,
            weight: str | None = None) -> DataFrame:
    """(series, ``cell``, ``s``): sums of w * z_i * z_j over each series, z being the
    design and then the response, at cell i * (p + 1) + j; the cell after the last of
    them counts rows. A task holds about ``HELD`` series before it hands them on."""
    series = list(series)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*series, F.array_append(F.col(x), F.col(y).cast("double")).alias("z"), w.alias("w"))
    out = T.StructType([*[rows.schema[c] for c in series], T.StructField("block", T.ArrayType(T.DoubleType()))])

    def run(batches):
        held = {}
        for batch in batches:
            if not len(batch):
                continue
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            w = batch.column("w").to_numpy(zero_copy_only=False)
            places = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in series]) if series else [()] * len(z)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                block = np.append((z[at] * w[at, None]).T @ z[at], len(at))
                held[key] = held[key] + block if key in held else block
            if len(held) > HELD:
                yield blocks(held)
                held = {}
        if held:
            yield blocks(held)

    def blocks(held):
        keys = [pa.array(k, types[c]) for c, k in zip(series, zip(*held))] if series else []
        return pa.record_batch([*keys, pa.array([b.tolist() for b in held.values()], pa.list_(pa.float64()))],
                               [*series, "block"])

    types = {c: to_arrow_type(rows.schema[c].dataType) for c in series}
    return (rows.mapInArrow(run, out).select(*series, F.posexplode("block").alias("cell", "s"))
            .groupBy(*series, "cell").agg(F.sum("s").alias("s")))


def minimum_norm(a, b):
    """(coefficients, rank) of the normal equations a x = b, scaled to unit diagonal;
    of several solutions the smallest one."""
    size = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    scaled = a / np.outer(size, size)
    inverse = np.linalg.pinv(scaled, rcond=1e-10, hermitian=True)
    return inverse @ (b / size) / size, int(np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True))


def penalised(a, b, yy, n, soft, shrink, rounds=3):
    """(coefficients, degrees of freedom, residual sum of squares) where the columns
    ``soft`` have a normal prior around 0 with deviation ``shrink``. How hard it holds
    depends on the noise: at first what a fit without these columns leaves, then
    what the last fit left, for ``rounds`` fits."""
    hard = ~soft
    first, rank = minimum_norm(a[np.ix_(hard, hard)], b[hard])
    noise = max(yy - b[hard] @ first, 0.0) / max(n - rank, 1.0)
    for _ in range(rounds):
        full = a + np.diag(np.where(soft, noise / shrink ** 2, 0.0))
        coef, _ = minimum_norm(full, b)
        size = np.sqrt(np.where(np.diag(full) > 0, np.diag(full), 1.0))
        scale = np.outer(size, size)
        used = float(np.trace(np.linalg.pinv(full / scale, rcond=1e-10, hermitian=True) @ (a / scale)))
        rss = float(max(yy - 2 * b @ coef + coef @ a @ coef, 0.0))
        noise = rss / max(n - used, 1.0)
    return coef, used, rss


def solve(sums: DataFrame, series: Sequence[str], soft_from: int | None = None,
          shrink: float = 1.0) -> DataFrame:
    """Least squares per series from :func:`moments`: ``beta``, the residual sum of
    squares ``rss``, the weight total ``n``, the degrees of freedom ``used`` and the
    number of rows. Columns from ``soft_from`` on are penalised; without it, the
    minimum-norm solution, so that redundant dummies need no dropping."""
    series = list(series)
    out = T.StructType([*[sums.schema[c] for c in series], *[
        T.StructField(c, t) for c, t in (("beta", T.ArrayType(T.DoubleType())), ("rss", T.DoubleType()),
                                         ("n", T.DoubleType()), ("used", T.DoubleType()), ("rows", T.LongType()))]])

    def one(cells: pd.DataFrame) -> pd.DataFrame:
        s = cells.sort_values("cell")["s"].to_numpy()
        p = int(round(np.sqrt(len(s) - 1))) - 1
        z = s[:-1].reshape(p + 1, p + 1)
        a, b, yy = z[:p, :p], z[:p, p], z[p, p]
        if soft_from is None:
            coef, used = minimum_norm(a, b)
            rss = float(max(yy - b @ coef, 0.0))
        else:
            coef, used, rss = penalised(a, b, yy, z[0, 0], np.arange(p) >= soft_from, shrink)
        return pd.DataFrame([[*(cells[c].iloc[0] for c in series), coef.tolist(), rss, float(z[0, 0]), float(used),
                              int(s[-1])]], columns=[f.name for f in out.fields])

    keyed = sums if series else sums.withColumn("_all", F.lit(0))
    return keyed.groupBy(*(series or ["_all"])).applyInPandas(one, out)


def attach(df: DataFrame, table: DataFrame, series: Sequence[str], *columns: str) -> DataFrame:
    """Put per-series columns on every row; a null key is a series of its own."""
    if series:
        keys = table.select(*[F.col(c).alias(f"_of_{c}") for c in series], *columns)
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in series]
        return df.join(keys, same).drop(*[f"_of_{c}" for c in series])
    one = table.agg(F.first(F.struct(*columns)).alias("s")).scalar()
    return df.withColumn("_s", one).select("*", *[F.col(f"_s.{c}").alias(c) for c in columns]
                                           ).drop("_s")
