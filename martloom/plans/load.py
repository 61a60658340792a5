"""Loading core tables: all of them, checked, or none."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.quality import check_fk, check_unique, reconcile, require
from ..sources.schemas import LOAD_ORDER, SCHEMAS
from ..sources.shelf import Shelf
from ..sources.sinks import conform

#: Key columns of each core table, and its foreign keys: column to (parent, column).
KEYS = {"dim_date": ["date_key"], "dim_item": ["item_key"], "dim_channel": ["channel_key"], "dim_zone": ["zone_key"],
        "dim_driver": ["driver_key"], "dim_cost_assumption": ["cost_item"], "dim_customer": ["customer_key"],
        "fct_order": ["order_key"], "fct_order_item": ["order_item_key"], "fct_shift": ["shift_key"],
        "daily_entry": ["business_date"]}
PARENTS = {"dim_customer": {"zone_key": ("dim_zone", "zone_key")},
           "fct_order": {"date_key": ("dim_date", "date_key"), "customer_key": ("dim_customer", "customer_key"),
                         "channel_key": ("dim_channel", "channel_key"), "zone_key": ("dim_zone", "zone_key"),
                         "driver_key": ("dim_driver", "driver_key")},
           "fct_order_item": {"order_key": ("fct_order", "order_key"), "date_key": ("dim_date", "date_key"),
                              "item_key": ("dim_item", "item_key")},
           "fct_shift": {"date_key": ("dim_date", "date_key")}}
#: Sums that have to survive the load.
SUMS = {"fct_order": ["gross_amount", "net_revenue"], "fct_order_item": ["line_revenue"], "fct_shift": ["labour_cost"]}


def load(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], mode: str = "append",
         schemas: Mapping[str, str] = SCHEMAS, order: Sequence[str] = LOAD_ORDER,
         keys: Mapping[str, Sequence[str]] = KEYS, parents: Mapping[str, Mapping] = PARENTS,
         sums: Mapping[str, Sequence[str]] = SUMS, rules: Callable | None = None) -> int:
    """Load ``tables`` into the shelf at ``path`` in one commit; returns its number.

    Parents are written before children. A table is coerced to its schema, its key has
    to be unique over old and new rows, required columns have values, foreign keys
    have parents (of this load or an earlier one; null is allowed), and rows and sums have to be
    those of the source. ``rules(read)`` may check more. The first
    violation raises, and every table stays as it was. ``mode``: ``append`` or ``replace``.
    """
    unknown = set(tables) - set(order)
    if unknown:
        raise ValueError(f"no place in the order: {sorted(unknown)}")
    with Shelf(spark, path).change() as change:
        for name in [n for n in order if n in tables]:
            source, schema = tables[name], StructType.fromDDL(schemas[name])
            out = conform(source, schema)
            had = change.read(name) if mode == "append" and change.has(name) else None
            change.put(out, name, mode=mode if had is not None else "replace")
            now = change.read(name)
            required = [f.name for f in schema.fields if not f.nullable]
            if required:
                empty = now.filter(F.exists(F.array(*[F.col(c).isNull() for c in required]), lambda b: b))
                require(empty, f"{name}: required values")
            require(check_unique(now, keys[name]), f"{name}: key")
            for column, (parent, key) in parents.get(name, {}).items():
                if not change.has(parent):
                    raise ValueError(f"{name}: {parent} has never been loaded")
                require(check_fk(out, column, change.read(parent), key), f"{name}: {column}")
            told = [c for c in sums.get(name, []) if c in source.columns]
            gained = _sums(now, told, 1)
            if had is not None:
                gained = gained.unionByName(_sums(had, told, -1))
            both = gained.unionByName(_sums(source, told, -1))
            require(both.groupBy("measure").agg(F.sum("value").alias("off")).filter("off != 0"), f"{name}: sums")
        if rules is not None:
            rules(change.read)
    return change.number


def _sums(df, columns, sign):
    """(measure, value): rows and column sums, signed."""
    sides = reconcile(df, df, columns).select("measure", F.coalesce("source", F.lit(0)).alias("value"))
    return sides.withColumn("value", F.col("value") * sign)
