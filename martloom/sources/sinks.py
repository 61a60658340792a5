"""Sinks: mart replacement, exports, bulk loads, upserts, manifests."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.quality import check_schema, require
from .shelf import Shelf


def write_mart(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = (),
               mode: str = "replace") -> int:
    """Replace the mart ``name`` under root/mart, or (``mode='changed'``) the parts of
    it whose rows differ, in one commit; returns its number. Readers see the old
    mart until then, whatever happens in between."""
    with Shelf(df.sparkSession, f"{root}/mart").change() as change:
        change.put(df, name, partition_by, mode)
    return change.number


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        df.write.option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(fmt)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to the target schema; whole-number fractions become integers."""
    require(check_schema(df, schema), "schema")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def bulk_append(df: DataFrame, target_schema: StructType, path: str,
                fmt: str = "parquet", null_marker: str = "\\N") -> None:
    """Append after coercion; CSV output marks NULL explicitly and writes
    booleans as t/f."""
    out = conform(df, target_schema)
    if fmt == "csv":
        flags = [f.name for f in target_schema.fields if f.dataType.typeName() == "boolean"]
        out = out.withColumns({c: F.when(F.col(c), "t").when(~F.col(c), "f") for c in flags})
        out.write.mode("append").option("nullValue", null_marker).option(
            "emptyValue", '""').csv(path)
    else:
        out.write.mode("append").parquet(path)


def upsert_latest(log: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row per key of an append-only log.

    ``order_by`` must be total within a key. Runs as a combinable aggregate:
    a key with very many corrections is reduced before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*log.columns)


def upsert_actions(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """'updated' for keys that were there, 'saved' for the others."""
    had = existing.select(key).distinct().withColumn("_had", F.lit(True))
    return new.select(key).distinct().join(had, key, "left").select(
        key, F.when(F.col("_had"), "updated").otherwise("saved").alias("action"))


def manifest(tables: Mapping[str, DataFrame],
             sums: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """(table, measure, value): row counts plus named headline sums."""
    sums, out = sums or {}, None
    for name, df in tables.items():
        asked = sums.get(name, {})
        t = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), *[
            F.sum(c).cast("double").alias(m) for m, c in asked.items()])
        long = t.select(F.lit(name).alias("table_name"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"))
            for m in ["rows", *asked]])))
        out = long if out is None else out.unionByName(long)
    return out


def observed_write(df: DataFrame, path: str, sums: Mapping[str, str] | None = None) -> dict:
    """Write and count in the same pass."""
    from pyspark.sql import Observation
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"),
               *[F.sum(c).alias(m) for m, c in (sums or {}).items()]).write.parquet(path)
    return seen.get


__all__ = ["bulk_append", "conform", "export", "manifest", "observed_write",
           "upsert_actions", "upsert_latest", "write_mart"]
