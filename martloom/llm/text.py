"""Column expressions for texts."""

from pyspark.sql import Column, functions as F

SPACE = " \t\n\x0b\f\r"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def body(c) -> Column:
    """The text, empty if null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, A_TO_Z, A_TO_Z.lower())


def words(c: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    inner = F.trim(c, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))
