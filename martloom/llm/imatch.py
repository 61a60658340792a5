"""I-Match fingerprints with randomised lexicon subsets. Native expressions only."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.stable import stable
from .text import body, lower_ascii

TERM_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ALWAYS = 0  # a mark that stands in every text, so that texts without lexicon terms stay
LOW_32 = 0xFFFFFFFF
FIRST_LEVEL = 3  # subsets of the first level hold one term in 2^3


def _terms(c):
    """Distinct hashed terms: letters and digits, lower case, any other script as it is."""
    return F.transform(F.array_remove(F.array_distinct(F.split(lower_ascii(c), TERM_BREAKS)), ""),
                       lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.1, levels: int = 8, each: int = 6,
            most: int = 4_000_000) -> DataFrame:
    """(h, mask): terms in more than ``low`` and at most ``high`` of the documents,
    that is in a band of inverse document frequency, and the subsets they belong
    to. A subset of level l holds each term with probability 2^-l, decided by a
    hash, so that texts of any length meet subsets that hold a few of their terms.

    The lexicon has fewer than (distinct terms of a mean document) / ``low`` terms
    however many documents there are, which is why it may be broadcast; that it
    stays below ``most`` is checked.
    """
    n = docs.count()
    df = (docs.select(F.explode(_terms(body("text"))).alias("h")).groupBy("h")
          .agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") > max(1, low * n)) & (F.col("df") <= max(high * n, 2))))
    mask = sum((F.when(F.pmod(F.xxhash64("h", F.lit(j)), F.lit(1 << (j // each + FIRST_LEVEL))) == 0, F.lit(1 << j))
                .otherwise(F.lit(0)) for j in range(levels * each)), F.lit(0).cast("long"))
    kept = stable(df.filter(F.col("h") != ALWAYS).select("h", mask.alias("mask")), "lexicon")
    if kept.count() > most:
        raise ValueError("the lexicon is too large to be broadcast: raise `low`")
    return kept


def _placed(docs, buckets):
    """Rows in buckets of neighbouring doc_ids, the first row of the following
    bucket (in descending order) once more as ``ghost`` = 1. The last bucket's
    follower is the first bucket."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body("text").alias("body"))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)
                     if buckets > 1 else F.array().cast("array<long>")).first()[0] or []
    bounds = sorted(set(bounds))
    steps = [1 << i for i in range(len(bounds).bit_length(), -1, -1)]
    # binary search; a null doc_id comes after all others in descending order
    at = F.expr(f"""aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) ->
        if(lo + s <= {len(bounds)} and get(array({', '.join(f'{b}L' for b in bounds)}), lo + s - 1) <= doc_id, lo + s, lo))"""
                ) if bounds else F.lit(0)
    ids = ids.withColumn("b", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at))
    # one row per bucket
    tops = [(r["b"], r["top"]) for r in ids.groupBy("b").agg(F.max("doc_id").alias("top")).orderBy(F.desc("b")).collect()]
    # rows with a bucket's largest doc_id also follow the bucket before it
    top, target = {b + 1: t for b, t in tops}, {after + 1: b for (b, _), (after, _) in zip(tops, tops[1:] + tops[:1])}
    listed = lambda of, kind: F.lit([of.get(i) for i in range(len(bounds) + 2)]).cast(f"array<{kind}>")
    at = F.col("b") + 1
    follower = F.when(F.col("doc_id").eqNullSafe(F.get(listed(top, "bigint"), at)), F.get(listed(target, "int"), at))
    return (ids.withColumn("both", F.array_compact(F.array(
                F.struct("b", F.lit(0).alias("ghost")),
                F.when(follower.isNotNull(), F.struct(follower.alias("b"), F.lit(1).alias("ghost"))))))
            .select("doc_id", "body", F.inline("both")))


def _slots(terms, levels, each):
    """Hashes of the sorted distinct terms of the whole lexicon and of each subset; 0
    if none. Every second level the terms that no further subset holds are left
    behind, which halves the work again and again."""
    one = f"if(size({{0}}) = 0, 0L, greatest(xxhash64({{0}}) & {LOW_32}L, 1L))"
    parts, inner = [f"array({one.format(f'transform({terms}, x -> x.h)')})"], None
    for first in reversed(range(0, levels, 2)):
        own = ", ".join(f"""transform(array(filter(t{first}, x -> x.mask & {1 << j}L != 0)),
                            s -> {one.format('s')})[0]""" for j in range(first * each, min(first + 2, levels) * each))
        rest = sum(1 << j for j in range(first * each, levels * each))
        above = terms if first == 0 else f"t{first - 2}"
        inner = f"""transform(array(filter({above}, x -> x.mask & {rest}L != 0)), t{first} ->
                    {f'concat(array({own}), {inner})' if inner else f'array({own})'})[0]"""
    return F.expr(f"concat({parts[0]}, {inner})")


def _likeness(a, b):
    """Share of the subsets with terms in either text that hash alike."""
    return F.expr(f"""size(filter({a}, (x, i) -> x != 0 and x = {b}[i]))
                      / size(filter({a}, (x, i) -> x != 0 or {b}[i] != 0))""").cast("double")


def _shown(slots):
    return F.array_join(F.transform(slots, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def fingerprints(docs: DataFrame, levels: int = 8, each: int = 6, buckets: int | None = None, **band) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are left out): doc_id,
    ``n_chars``, ``edited_sha256``, the fingerprints of the text and of its edited
    form, and how alike the fingerprint is to the edited one's and to the next
    document's.

    The edited form has the last half of the characters replaced by the first as
    many of the next document in descending doc_id (equal ids: by the text's
    hash); after the last comes the first. A null text is empty. A text without
    lexicon terms is fingerprinted by all its terms. Repeated rows are
    documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    words = lexicon(docs, levels=levels, each=each, **band).unionByName(
        spark.range(1).select(F.lit(ALWAYS).cast("long").alias("h"), F.lit(0).cast("long").alias("mask")))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = W.partitionBy("b").orderBy("ghost", F.desc_nulls_last("doc_id"), "tie")
    half = F.floor(F.length("body") / 2).cast("int")
    rows = (_placed(docs, buckets).withColumn("tie", F.xxhash64("body"))
            .withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("body").over(order))
            .withColumn("edited", F.concat(F.expr("left(body, length(body) - cast(floor(length(body) / 2) as int))"),
                                           F.coalesce(F.substring(F.col("next"), F.lit(1), half), F.lit(""))))
            .drop("next", "tie")
            .withColumn("t", _terms(F.col("body"))).withColumn("e", _terms(F.col("edited"))))
    every = lambda c: F.greatest(F.xxhash64(F.sort_array(c)).bitwiseAND(F.lit(LOW_32)), F.lit(1).cast("long"))
    meta = F.struct("doc_id", "ghost", F.length("body").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    every("t").alias("all_t"), every("e").alias("all_e"))
    none = F.lit(None).cast("struct<doc_id:bigint,ghost:int,n_chars:bigint,edited_sha256:string,all_t:bigint,all_e:bigint>")
    items = F.concat(
        F.array(F.struct(F.lit(ALWAYS).cast("long").alias("h"), F.lit(False).alias("e"), meta.alias("meta"))),
        F.transform("t", lambda h: F.struct(h.alias("h"), F.lit(False).alias("e"), none.alias("meta"))),
        F.transform("e", lambda h: F.struct(h.alias("h"), F.lit(True).alias("e"), none.alias("meta"))))
    # the lookups stay in the bucket's task: grouping by (b, at) needs no further shuffle
    held = (rows.select("b", "at", F.inline(items)).join(F.broadcast(words), "h")
            .groupBy("b", "at").agg(
                F.max("meta").alias("meta"),
                F.sort_array(F.collect_list(F.when((F.col("h") != ALWAYS) & ~F.col("e"), F.struct("h", "mask")))).alias("t"),
                F.sort_array(F.collect_list(F.when(F.col("e"), F.struct("h", "mask")))).alias("e")))
    n = levels * each
    slotted = held.select("b", "at", "meta.*", _slots("t", levels, each).alias("st"), _slots("e", levels, each).alias("se"))
    first = lambda s, c: F.concat(F.array(F.when(F.col(s)[0] == 0, F.col(c)).otherwise(F.col(s)[0])),
                                  F.slice(s, 2, n))
    slotted = slotted.withColumn("st", first("st", "all_t")).withColumn("se", first("se", "all_e"))
    ahead = F.lead("st").over(W.partitionBy("b").orderBy("at"))
    # a single document is its own next one
    return (slotted.withColumn("sn", F.coalesce(ahead, "st")).filter("ghost = 0").select(
        "doc_id", "n_chars", "edited_sha256", _shown("st").alias("fingerprint"),
        _shown("se").alias("edited_fingerprint"), _likeness("st", "se").alias("near_edited"),
        _likeness("st", "sn").alias("near_next")))
