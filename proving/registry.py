"""One place where queries and their SQL checks are registered."""

from pyspark.sql import functions as F

from .star import Star

QUERIES, ORACLES = {}, {}


def shown(df):
    """Plain types at the comparison boundary: decimals as doubles, dates and
    timestamps as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "decimal":
            c = c.cast("double")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("short", "byte"):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name, oracle=None):
    """Register ``fn(star) -> DataFrame`` under ``name``."""
    def keep(fn):
        def run(spark, sf_dir):
            return shown(fn(Star(spark, sf_dir)))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep
