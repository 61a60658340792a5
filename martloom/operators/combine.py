"""Joins and set operations."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import col


def flag_members(df: DataFrame, other: DataFrame, key: str, out: str) -> DataFrame:
    """True where ``key`` occurs in ``other``; rows are never multiplied."""
    present = other.select(key).distinct().withColumn(out, F.lit(True))
    return (df.join(present, key, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(False))))


def span_days(spans: DataFrame, start: str = "start", end: str = "end",
              day: str = "day") -> DataFrame:
    """Every date covered by at least one inclusive span, once."""
    return (spans.select(F.explode(F.sequence(start, end)).alias(day)).distinct())


def in_spans(df: DataFrame, date: str, spans: DataFrame, start: str = "start",
             end: str = "end", out: str = "in_span") -> DataFrame:
    """Flag dates inside any span. The interval test becomes an equi-join on
    the days the spans cover, so no row is compared with every span."""
    return flag_members(df, span_days(spans, start, end, date), date, out)


def with_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join a keyed table; misses are NULL."""
    return df.join(table, key, "left")


def with_variants(df: DataFrame, variants: Sequence[Mapping], types: str) -> DataFrame:
    """Every row once per variant of a short fixed list (item x size).

    The list is expanded inside each row, so nothing is joined or shuffled.
    """
    names = [part.split()[0] for part in types.split(", ")]
    wanted = dict(part.split(" ", 1) for part in types.split(", "))
    rows = F.array(*[F.struct(*[F.lit(v[n]).cast(wanted[n]).alias(n) for n in names])
                     for v in variants])
    return df.select("*", F.inline(rows))


def exclude_keys(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None):
    """Rows whose key is not in ``other``. For a non-null key this equals
    ``NOT IN`` and plans as an ordinary anti join."""
    taken = other.select(F.col(other_key or key).alias(key)).distinct()
    return df.join(taken, key, "left_anti")


def missing_keys(domain: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return exclude_keys(domain.select(key).distinct(), df, key)


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL by name; a column absent from a part becomes a typed NULL."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def replace_by_key(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the old rows of every key in ``new``, then append ``new``."""
    return exclude_keys(df, new, key).unionByName(new)


def unpivot_lines(df: DataFrame, lines: Mapping, label: str = "line",
                  value: str = "amount", keep: Sequence[str] = ()) -> DataFrame:
    """One row per labelled expression, in one pass over ``df``."""
    rows = F.array(*[F.struct(F.lit(n).alias(label), col(e).alias(value))
                     for n, e in lines.items()])
    return df.select(*keep, F.inline(rows))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Long to wide over a known short list of column values."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)
