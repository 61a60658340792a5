"""Market basket rules between pairs of item names."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import half_even
from .order import number_rows, top_k
from .stable import stable


def baskets(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (order, item name): sizes collapse, quantity is ignored.

    Repeats are removed per (order, item) before names are joined and again
    after, both times combined map-side.
    """
    pairs = lines.select("order_key", "item_key").distinct()
    return (pairs.join(items.select("item_key", "item_name"), "item_key")
            .select("order_key", "item_name").distinct())


def item_support(baskets_: DataFrame, min_support: float = 0.01) -> DataFrame:
    """Item names with their order count and support, if frequent enough."""
    total = baskets_.agg(F.countDistinct("order_key").alias("n")).scalar()
    return (baskets_.groupBy("item_name").agg(F.count(F.lit(1)).alias("orders"))
            .withColumn("total", total)
            .withColumn("support", F.col("orders") / F.col("total"))
            .filter(F.col("support") >= min_support))


def pair_counts(baskets_: DataFrame, frequent: DataFrame) -> DataFrame:
    """How many orders hold both names, for names in ``frequent``.

    An order keeps only frequent names, in one sorted array, and each name is
    paired with the slice after it; counts combine before the shuffle. The
    work per order is bounded by the data-independent number of frequent
    names: supports add up to the mean basket width, so at most
    width / min_support names qualify, however large a single order is.
    """
    kept = baskets_.join(frequent.select("item_name"), "item_name")
    arrays = (kept.groupBy("order_key")
              .agg(F.sort_array(F.collect_set("item_name")).alias("names"))
              .filter(F.size("names") > 1))
    firsts = arrays.select("names", F.posexplode("names").alias("pos", "item_a"))
    return (firsts.select("item_a", F.explode(F.slice(
                "names", F.col("pos") + 2, F.size("names"))).alias("item_b"))
            .groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("together")))


def pair_rules(baskets_: DataFrame, min_support: float = 0.01, min_lift: float = 1.05,
               max_rules: int = 200) -> DataFrame:
    """Rules a -> b in both directions with support, confidence and lift.

    Thresholds are inclusive and compared before rounding; the list is sorted
    by rounded lift, then by the names. ``baskets_`` is read three times, so
    pass a stored frame when it is expensive.
    """
    single = stable(item_support(baskets_, min_support), "items")
    counts = pair_counts(baskets_, single)
    a = single.select(F.col("item_name").alias("item_a"), F.col("orders").alias("na"), "total")
    b = single.select(F.col("item_name").alias("item_b"), F.col("orders").alias("nb"))
    joined = (counts.join(a, "item_a").join(b, "item_b")
              .withColumn("support", F.col("together") / F.col("total"))
              .filter(F.col("support") >= min_support)
              .withColumn("lift", F.col("together") * F.col("total")
                          / (F.col("na") * F.col("nb")).cast("double"))
              .filter(F.col("lift") >= min_lift))
    both = joined.select("support", "lift", F.inline(F.array(
        F.struct(F.col("item_a"), F.col("item_b"),
                 (F.col("together") / F.col("na")).alias("confidence")),
        F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"),
                 (F.col("together") / F.col("nb")).alias("confidence")))))
    rules = both.select("item_a", "item_b", half_even("support", 4).alias("support"),
                        half_even("confidence", 4).alias("confidence"),
                        half_even("lift", 3).alias("lift"))
    return top_k(rules, [F.col("lift").desc(), "item_a", "item_b"], max_rules, "rule_key")


def itemsets_fpgrowth(baskets_: DataFrame, min_support: float = 0.01) -> DataFrame:
    """Frequent itemsets of any size, pairs agree with :func:`pair_rules`.

    FP-growth's projection as DataFrame steps: a row is a set and what may still follow
    it in a basket, rarest names first, and equal rows are one row with a count. Each
    round extends the sets by one name, counts them (combined map-side) and goes on
    with the frequent ones alone.
    """
    frequent = stable(item_support(baskets_, min_support), "items")
    codes = stable(number_rows(frequent, ["orders", "item_name"], "code").select(
        "item_name", F.col("code").cast("int").alias("code")), "codes")
    total = frequent.agg(F.max("total").alias("t")).scalar()
    rest = (baskets_.join(codes.select("item_name", "code"), "item_name").groupBy("order_key")
            .agg(F.sort_array(F.collect_set("code")).alias("rest")))
    rows = stable(rest.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).select(
        F.array().cast("array<int>").alias("items"), "rest", "n"), "projected")
    levels = []
    while True:
        longer = rows.select("items", "rest", "n", F.posexplode("rest").alias("at", "code")).select(
            F.concat("items", F.array("code")).alias("items"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n")
        levels.append(stable(longer.groupBy("items").agg(F.sum("n").alias("orders")).filter(
            F.col("orders") / total >= min_support), "sets"))
        if levels[-1].isEmpty():
            break
        rows = stable(longer.filter(F.size("rest") > 0).join(levels[-1].select("items"), "items")
                      .groupBy("items", "rest").agg(F.sum("n").alias("n")), "projected")
    return (reduce(DataFrame.unionByName, levels)
            .select("items", "orders", F.explode("items").alias("code"))
            .join(codes.select("item_name", "code"), "code").groupBy("items", "orders")
            .agg(F.sort_array(F.collect_list("item_name")).alias("names"))
            .select(F.col("names").alias("items"), "orders"))
