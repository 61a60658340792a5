"""Labels derived from values: dayparts, segments, bands, names."""

from itertools import chain

from pyspark.sql import Column, functions as F

from ..fixed_values import DAYPARTS
from .numeric import col


def value_map(c, mapping, default=None) -> Column:
    """Look a value up in a small literal map; misses give ``default``."""
    pairs = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    found = F.try_element_at(pairs, col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def names_of(position, names) -> Column:
    """1-based position -> name."""
    # one literal, folded to an array once per query
    return F.element_at(F.split(F.lit("|".join(names)), "[|]"), col(position).cast("int"))


def date_key_of(day) -> Column:
    """yyyymmdd as an integer, by arithmetic rather than text formatting."""
    day = col(day)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def date_of_key(key) -> Column:
    key = col(key)
    return F.make_date(F.floor(key / 10000).cast("int"),
                       F.floor(key / 100).cast("int") % 100, key % 100)


def daypart(ts, bands=DAYPARTS) -> Column:
    """Service period of a timestamp; NULL outside every band."""
    hour = F.hour(col(ts))
    out = None
    for name, first, until in bands:
        hit = (hour >= first) & (hour < until)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_late(actual, promised) -> Column:
    """Strictly over the promise; NULL when there was no promise."""
    return col(actual) > col(promised)


def late_minutes_over(actual, promised) -> Column:
    return F.greatest(col(actual) - col(promised), F.lit(0))


def bin_fixed(c, edges, labels) -> Column:
    """Right-closed bins ``(edge[i], edge[i+1]]``; NULL outside them."""
    c = col(c)
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (c > F.lit(low)) & (c <= F.lit(high))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def rfm_segment(r, f) -> Column:
    """Ordered rules over the recency and frequency scores; first match wins."""
    r, f = col(r), col(f)
    return (F.when((r >= 4) & (f >= 4), "Champion")
            .when((r >= 3) & (f >= 3), "Loyal")
            .when((r >= 4) & (f <= 2), "New / Promising")
            .when((r <= 2) & (f >= 4), "At risk - was valuable")
            .when((r <= 2) & (f >= 2), "Slipping away")
            .when(r <= 2, "Lost")
            .otherwise("Occasional"))
