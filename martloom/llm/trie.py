"""The trie of conversation prefixes, with subtree sums by depth bands.

A node is a distinct sequence of first turns. Its key is the exclusive-or of two
64-bit hashes of (depth, turn) over its turns, so a key needs no parent to be known
first. Depths are cut into bands of fixed height. For a subtree sum, each node
gives its value to its ancestors inside its own band only, ``height`` at most. The
band roots, with what their bands hold, form a trie of a ``height``-th of the depth,
whose subtree sums are taken in the same way; each completed band root then gives
its total to the ancestors in the band above it. Rounds grow with the logarithm of
the depth, a row explodes to at most 2 * ``height`` rows, and sums combine before
they are shuffled, so that the root's members meet as partial sums.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.order import global_rank
from ..operators.stable import stable
from .text import body

KEY = ["a", "b"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ``at`` (place from 0), ``digest`` and ``bytes`` of each turn.

    Order is by turn, null first, then by the digest of (role, text), so that ties
    have a defined order; rows that repeat are turns of their own. A null role or text
    is empty. Rows without conv_id belong to no conversation and are left out, and so
    are other columns. Places come from a range sort: a conversation of any length is
    spread over tasks.
    """
    role = body("role")
    read = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, body("text")), 256).alias("digest"),
        F.octet_length(body("text")).cast("long").alias("bytes")).filter("conv_id is not null")
    # copies of a row are apart, so that a range can end between them
    apart = read.withColumn("copy", F.monotonically_increasing_id())
    placed = global_rank(apart, ["turn", "digest", "copy"], "at", by=["conv_id"])
    return stable(placed.select("conv_id", (F.col("at") - 1).alias("at"), "digest", "bytes"), "turns")


def rebuilt(placed: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share their beginnings: conversation c takes the first
    crc32(c) % ``most`` turns of conversation c - c % ``step`` in place of its own.

    One row per conversation and depth from 0 (no turn yet): conv_id, depth, digest,
    bytes, and whether it is the ``last``. Lent are less than ``most`` turns each.
    """
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % step).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stable(convs.join(sizes, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")), "conversations")
    end = (F.col("depth") == F.col("lent") + F.col("own")).alias("last")
    heads = placed.filter(F.col("at") < most - 1).withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").filter("at < lent").withColumn("depth", F.col("at") + 1)
    own = placed.join(convs.filter("own > 0"), "conv_id").filter("at >= h").withColumn(
        "depth", F.col("at") - F.col("h") + F.col("lent") + 1)
    start = convs.select("*", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"),
                         F.lit(0).cast("long").alias("bytes"))
    columns = ["conv_id", "depth", "digest", "bytes", end]
    return start.select(columns).unionByName(lent.select(columns)).unionByName(own.select(columns))


def keyed(rows: DataFrame, height: int) -> DataFrame:
    """The key (``a``, ``b``) of each row's prefix and that of its parent (``pa``,
    ``pb``). ``rows`` have conv_id, depth, digest; depth 0 has the key (0, 0)."""
    def hashed(seed):
        return F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(F.lit(0))

    own = stable(rows.withColumns({"xa": hashed(11), "xb": hashed(29)}).drop("digest"), "hashed")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    done = _running_xor(own, deepest, height)
    return done.withColumns({"pa": F.col("a").bitwiseXOR(F.col("xa")), "pb": F.col("b").bitwiseXOR(F.col("xb"))}
                            ).drop("xa", "xb")


def _running_xor(rows, deepest, height):
    """``a``, ``b``: the exclusive-or of ``xa``, ``xb`` over a conversation's rows up
    to this one. A window holds one band; band totals are summed up in the same way."""
    inside = W.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    banded = rows.withColumn("band", F.floor(F.col("depth") / height))
    out = banded.withColumns({"a": F.bit_xor("xa").over(inside), "b": F.bit_xor("xb").over(inside)})
    if deepest < height:
        return out.drop("band")
    totals = banded.groupBy("conv_id", "band").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
    upto = _running_xor(stable(totals.withColumnRenamed("band", "depth"), "bands"), deepest // height, height).select(
        "conv_id", (F.col("depth") + 1).alias("band"), F.col("a").alias("a_before"), F.col("b").alias("b_before"))
    return out.join(upto, ["conv_id", "band"], "left").withColumns({
        x: F.col(x).bitwiseXOR(F.coalesce(f"{x}_before", F.lit(0))) for x in KEY}).drop("band", "a_before", "b_before")


def paths(rows: DataFrame, height: int) -> DataFrame:
    """(conv_id, band, ``path``): the keys of a conversation's prefixes in a band, from
    the top down, ``height`` at most. ``rows`` have conv_id, level and the key."""
    return rows.groupBy("conv_id", F.floor(F.col("level") / height).alias("band")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", *KEY))), lambda x: F.struct(*[x[k].alias(k) for k in KEY]))
        .alias("path"))


def subtree_sums(nodes: DataFrame, rows: DataFrame, values, deepest: int, height: int) -> DataFrame:
    """(key, values): ``values`` summed over each node's subtree, itself included.

    ``nodes`` have the key, ``level`` (0 to ``deepest``), a ``conv_id`` that passes
    through them, and values; ``rows`` the keys of all conversations by level.
    """
    ways = stable(paths(rows, height), "paths")
    band, place = F.floor(F.col("level") / height), (F.col("level") % height).cast("int")

    def given(some, path):
        sums = [F.sum(v).alias(v) for v in values]
        return some.select(F.explode(path).alias("_k"), *values).groupBy("_k.a", "_k.b").agg(*sums)

    within = given(nodes.withColumn("band", band).join(ways, ["conv_id", "band"]),
                   F.slice("path", 1, place + 1))
    if deepest < height:
        return within
    within = stable(within, "within")
    roots = (nodes.filter(place == 0).select(*KEY, "conv_id", band.alias("level")).join(within, KEY))
    tops = rows.filter(place == 0).select("conv_id", *KEY, band.alias("level"))
    complete = stable(subtree_sums(stable(roots, "roots"), stable(tops, "tops"), values, deepest // height, height)
                      .join(roots.select(*KEY, "conv_id", "level"), KEY), "complete")
    above = given(complete.filter("level > 0").withColumn("band", F.col("level") - 1)
                  .join(ways, ["conv_id", "band"]), F.col("path"))
    return within.unionByName(above).groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def ends(rows: DataFrame, per_chunk_bits: int = 12) -> DataFrame:
    """(key, ``ends_sha256``): SHA-256 of the ids of the conversations that end in a
    node, ascending and comma-joined.

    Ids are joined in parallel, 4,096 neighbouring ones at most in a string. A digest
    has to be taken in order, so the strings of a node stream through one task, which
    holds one of them at a time.
    """
    chunks = rows.filter("last").groupBy(*KEY, F.shiftright("conv_id", per_chunk_bits).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    sorted_chunks = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256(ids.encode())
            yield from as_batch(done)
        yield from as_batch([(*now, digest.hexdigest())] if now is not None else [])

    def as_batch(done):
        if done:
            a, b, text = zip(*done)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text)],
                                  ["a", "b", "ends_sha256"])

    return sorted_chunks.mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(rows: DataFrame, height: int = 16, wide: int = 100_000) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, depth, digest, bytes, last;
    depths of a conversation run from 0 without a gap).

    conv_id is the smallest member, parent_conv_id its parent's (null at the root),
    n_leaves and saved_tokens are over the subtree: nodes without children, and the
    bytes of the last text times the members beyond the first. A table without
    conversations has no root and gives no rows. ``height``: of a band; ``wide``: a
    parent of more children is looked up apart, so that its children do not meet.
    """
    rows = stable(keyed(rows, height), "prefixes")
    # depth, parent and bytes follow from the key
    nodes = stable(rows.groupBy(*KEY, "depth", "pa", "pb", "bytes").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stable(nodes.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(nodes.select(*KEY, F.col("depth").alias("level"), "conv_id", *values),
                        rows.select("conv_id", *KEY, F.col("depth").alias("level")), values, deepest, height)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    full = (nodes.drop(*values).join(sums, KEY).join(ends(rows), KEY, "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", none)))
    parents = nodes.filter("n_children > 0").select(
        F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    # each has more than ``wide`` children of its own: at most nodes / wide rows
    hot = F.broadcast(parents.filter(F.col("n_children") > wide).drop("n_children"))
    below, up = full.filter("depth > 0"), ["pa", "pb"]
    cold = below.join(hot, up, "left_anti").join(parents.drop("n_children"), up)
    named = cold.unionByName(below.join(hot, up)).unionByName(
        full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values, "ends_sha256")
