"""Sources: Parquet, CSV, JDBC, nested JSON payloads, small reference lists."""

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.combine import with_variants
from .shelf import Shelf


def read_table(spark: SparkSession, root: str, name: str,
               schema: StructType | str | None = None, suffix: str = "") -> DataFrame:
    """``layer.table`` or ``table`` under ``root``: the mart layer is the shelf in
    root/mart, every other layer lies in root. ``suffix`` is for single files."""
    layer, _, table = name.rpartition(".")
    if layer == "mart":
        return Shelf(spark, f"{root}/mart").read(table)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{table}{suffix}")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True)
            .option("mode", "FAILFAST").csv(path))


def read_jdbc(spark: SparkSession, url: str, name: str, partition: Mapping | None = None,
              **options) -> DataFrame:
    """Partitioned relational read: ``partition`` holds partitionColumn,
    lowerBound, upperBound and numPartitions."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for k, v in {**(partition or {}), **options}.items():
        reader = reader.option(k, v)
    return reader.load()


def parse_daily_arrays(df: DataFrame, json_col: str, fields: Mapping[str, str],
                       root: str = "daily", keep: Sequence[str] = ()) -> DataFrame:
    """Payloads with parallel arrays to one row per position.

    ``fields`` maps the array names to element types, e.g. {"time": "date"}.
    """
    inner = ", ".join(f"{n}: array<{t}>" for n, t in fields.items())
    parsed = F.from_json(json_col, f"struct<{root}: struct<{inner}>>")[root]
    zipped = F.arrays_zip(*[F.col(f"_d.{n}").alias(n) for n in fields])
    return (df.select(*keep, parsed.alias("_d"))
            .select(*keep, F.inline(zipped)))


def lookup(df: DataFrame, key_col: str, value) -> DataFrame:
    """Rows of one key; the predicate reaches the scan."""
    return df.filter(F.col(key_col) == F.lit(value))


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A literal table whose size the optimizer knows."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    return spark.createDataFrame(pa.table(
        {f.name: pa.array(list(c), arrow.field(f.name).type)
         for f, c in zip(struct.fields, columns)}), struct)


def reference_dims(spark: SparkSession, cfg: Mapping) -> dict[str, DataFrame]:
    """Small dimensions from reference lists.

    ``cfg`` may hold channels, zones, drivers, fixed_costs, variable_costs,
    school_holidays (row lists) and menu = {"sized": rows of (name, category,
    price, cost, vegetarian), "sizes": [(size, factor)], "plain": rows}.
    Items of the sized list appear once per size.
    """
    shapes = {
        "channels": "channel_key long, channel_name string, is_aggregator boolean, "
                    "commission_rate decimal(5,4)",
        "zones": "zone_key long, plz string, district_name string, distance_km decimal(5,2), "
                 "base_drive_min decimal(5,2), delivery_fee decimal(5,2)",
        "drivers": "driver_key long, driver_name string, vehicle string",
        "fixed_costs": "cost_item string, monthly_eur decimal(10,2), note string",
        "variable_costs": "cost_item string, rate decimal(6,4), base string, note string",
        "school_holidays": "name string, start date, end date"}
    out = {n: small_table(spark, cfg[n], s) for n, s in shapes.items() if n in cfg}
    if "menu" in cfg:
        out["items"] = _menu(spark, **cfg["menu"])
    return out


def _menu(spark, sized=(), sizes=(), plain=()):
    shape = ("item_name string, category string, price decimal(10,2), cost decimal(10,2), "
             "is_vegetarian boolean, pos int")
    a = small_table(spark, [(*r, i) for i, r in enumerate(sized)], shape)
    b = small_table(spark, [(*r, i) for i, r in enumerate(plain)], shape)
    variants = [{"size_name": n, "factor": f, "nth": i} for i, (n, f) in enumerate(sizes)]
    parts = []
    if variants:
        a = with_variants(a, variants, "size_name string, factor decimal(6,3), nth int")
        parts.append(a.withColumn("item_key", F.col("pos") * len(variants) + F.col("nth") + 1))
    parts.append(b.withColumns({
        "size_name": F.lit(None).cast("string"), "factor": F.lit(1).cast("decimal(6,3)"),
        "nth": F.lit(0), "item_key": F.col("pos") + len(sized) * len(variants) + 1}))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(
        F.col("item_key").cast("long").alias("item_key"), "item_name", "category", "size_name",
        F.round(F.col("price") * F.col("factor"), 2).cast("decimal(6,2)").alias("unit_price"),
        F.round(F.col("cost") * F.col("factor"), 2).cast("decimal(6,2)").alias("unit_cost"),
        "is_vegetarian")
