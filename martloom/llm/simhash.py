"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of the fingerprint gets a vector a(i) in GF(q)^3, and each direction v of
that space gives a mask: the bits with a(i).v != 0. Two fingerprints that differ
in at most two bits i, j have a direction with a(i).v = a(j).v = 0, so they are
equal under that mask: no pair within the radius is missed. Inside a bucket two
such fingerprints differ in hidden bits only, so each member is also written
with every single hidden bit flipped: members within two bits of each other,
and no others, share a written value. Each value links its members to the
smallest one; no pairs are formed, however large a bucket is.
"""

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.stable import stable
from .text import body, lower_ascii, words

BITS = 64


def masks(field: int = 2):
    """Kept-bit masks of the covering family over the prime ``field``: one per
    direction, each keeping about 1 - 1/field of the bits."""
    vectors = [v for v in product(range(field), repeat=3) if any(v)]
    # directions: one vector of each line, the one whose first nonzero entry is 1
    lines = [v for v in vectors if next(x for x in v if x) == 1]
    of_bit = [vectors[(i * 5 + 1) % len(vectors)] for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(of_bit) if sum(map(int.__mul__, a, v)) % field)
            for v in lines]


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3, key: bool = False) -> DataFrame:
    """doc_id and its 64-bit ``fp``, with ``key`` also the hash of the text itself. Lower-case A-Z, words between white space,
    shingles of ``width`` words (fewer words: all of them; none: fingerprint 0),
    XXH64 with seed 42; a bit is set if it is in over half the hashes. A null
    text has no words; other columns are left out."""
    joined = ", ' ', ".join(f"words[i + {k}]" for k in range(width))
    more = [F.xxhash64(body("text")).alias("key")] if key else []
    hashed = docs.select(F.col("doc_id").cast("long"), *more, words(lower_ascii(body("text"))).alias("words")).select(
        "doc_id", *(["key"] if key else []), F.expr(f"""
        case when size(words) >= {width}
             then transform(sequence(0, size(words) - {width}), i -> xxhash64(concat({joined})))
             when size(words) > 0 then array(xxhash64(array_join(words, ' ')))
             else array() end""").alias("h"))

    def run(batches):
        for batch in batches:
            lists = batch.column("h")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().view(np.uint8)
            out = np.zeros(len(lists), np.uint64)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                ones = np.zeros(BITS, np.int64)
                for at in range(a, b, 100_000):  # a long text piece by piece
                    some = flat[8 * at:8 * min(b, at + 100_000)].reshape(-1, 8)
                    ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)[0]
            yield pa.record_batch([*batch.columns[:-1], pa.array(out.view(np.int64))], names)

    names = [*hashed.columns[:-1], "fp"]
    return hashed.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def links(prints: DataFrame, field: int = 2) -> DataFrame:
    """(a, b): each fingerprint of a written value and the value's smallest.
    ``prints`` has distinct ``fp``. The components of these links are the
    components of all pairs within two bits."""
    kept = F.array(*[F.lit(_signed(m)) for m in masks(field)])
    hidden = F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1])
                       .cast("array<long>") for m in masks(field)])
    tabled = prints.select("fp", F.posexplode(kept).alias("t", "mask")).select(
        "fp", "t", F.expr("fp & mask").alias("bucket"))
    # a bucket of one has no pair; its members need not be written
    shared = (tabled.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("t", "bucket"))
    met = tabled.join(shared, ["t", "bucket"], "left_semi")
    written = met.select("fp", "t", F.explode(F.element_at(hidden, F.col("t") + 1)).alias("flip")).select(
        "fp", "t", F.expr("fp ^ flip").alias("value"))
    least = written.groupBy("t", "value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    return (written.join(least.filter("n > 1").drop("n"), ["t", "value"])
            .filter("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for the
    nodes that have edges. Alternates linking larger neighbours and all
    neighbours to a node's smallest one until nothing changes, a number of
    rounds that grows with the logarithm of the longest chain."""
    edges, before = stable(edges.select("a", "b"), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.filter("a != b").distinct()
        # now each node has smaller neighbours only: link all of them to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stable(large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
                       .filter("a != b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            # a star per component: every node once, its root beside it
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now


def groups(docs: DataFrame, width: int = 3, field: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fp`` and ``component_id``, the
    smallest doc_id that can be reached over links of at most two differing
    bits (a null doc_id counts as larger than any, and is only an id where a
    whole component has null). An empty table gives no rows."""
    prints = stable(fingerprints(docs, width), "prints")
    # from here on the work is on distinct fingerprints: copies are one row
    distinct = stable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = _rooted(distinct, field)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(distinct, field):
    """The rows of ``distinct`` (one per fingerprint) with their component's ``root``."""
    roots = components(links(distinct.select("fp"), field))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def keep_first(docs: DataFrame, width: int = 3, field: int = 2) -> DataFrame:
    """One row of each component, as it was: the one with the smallest doc_id (a null
    one counts as larger than any), then with the smallest hash of its text. Of rows
    that share both, any one stays. Columns may have any names."""
    prints = fingerprints(docs, width, key=True)
    # one row per fingerprint, its first document beside it
    each = prints.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")
    distinct = stable(each.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    first = stable(_rooted(distinct, field).groupBy("root").agg(F.min("first").alias("first"))
                   .select("first.doc_id", "first.key", "first.n"), "first")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(body("text")).alias("text_key"))
    found = rows.join(first, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")))
    if not first.filter("n > 1").head(1):
        return found.select("row.*")
    again = found.filter("n > 1").dropDuplicates(["id", "key"])
    return found.filter("n = 1").select("row.*").unionByName(again.select("row.*"))
