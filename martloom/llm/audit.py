"""What each filter removes in every order of filters, from decision diagrams.

The documents of a part become a diagram over failure masks: one level per filter,
a node per distinct function of the filters still to come, and a count vector at
each end. Two neighbouring levels can be swapped by rebuilding the nodes of these
two levels alone, so all orders are reached by adjacent swaps. Under an order, the
path on which every filter so far passed holds the documents still there: the pass
branch of its node is what stays, the fail branch what this filter removes.
"""

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.stable import stable
from .text import body, words

#: Kept apart in every count: all documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")


def text_rules() -> dict[str, Column]:
    """Failure conditions over ``_text`` and its ``_words``."""
    size, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    return {"A": size < 200, "B": 100 * distinct < 50 * size,
            "C": 100 * capitals > 3 * F.length("_text"), "D": F.col("_text").rlike("[#$%&*|]")}


class Diagram:
    """A count-weighted, level-ordered decision diagram of one part.

    ``nodes`` maps (level, pass child, fail child) to a number; children of the last
    level are count vectors. Equal nodes of a level are one node. No level is skipped,
    so a node's total is the sum of its children's.
    """

    def __init__(self, order: Sequence[str], counts: Mapping[int, Sequence[int]]):
        """``counts``: failure mask (bit k: filter order[k] fails) to a count vector."""
        self.order, self.children, self.totals, self.known = list(order), [], [], {}
        level = [self._end(tuple(counts.get(mask, (0,) * len(COUNTS)))) for mask in range(1 << len(order))]
        for k in reversed(range(len(order))):  # bit k is the highest still there
            half = 1 << k
            level = [self._node(k, level[i], level[i + half]) for i in range(half)]
        [self.root] = level

    def _end(self, vector):
        return self._keep(("end", vector), (), np.array(vector, np.int64))

    def _node(self, level, passed, failed):
        return self._keep((level, passed, failed), (passed, failed), self.totals[passed] + self.totals[failed])

    def _keep(self, key, children, total):
        if key not in self.known:
            self.known[key] = len(self.children)
            self.children.append(children)
            self.totals.append(total)
        return self.known[key]

    def swap(self, k):
        """Exchange the filters of levels ``k`` and ``k + 1``: below and above nothing
        changes but for the numbers of the nodes that lead there."""
        def again(node, level):
            a, b = self.children[node]
            if level < k:
                return self._node(level, again(a, level + 1), again(b, level + 1))
            (pp, pf), (fp, ff) = self.children[a], self.children[b]
            return self._node(k, self._node(k + 1, pp, fp), self._node(k + 1, pf, ff))

        self.root = again(self.root, 0)
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self):
        """Per filter of the order: (kept, removed) count vectors, along the path on
        which all filters pass."""
        node = self.root
        for name in self.order:
            passed, failed = self.children[node]
            yield name, self.totals[passed], self.totals[failed]
            node = passed


def swaps(n):
    """Levels whose adjacent swaps, one after the other, pass through every order of
    ``n`` filters once."""
    if n < 2:
        return
    for at, inner in enumerate([None, *swaps(n - 1)]):
        if inner is not None:  # the last filter waits at one end; the others move on
            yield inner + (at % 2 == 1)
        yield from reversed(range(n - 1)) if at % 2 == 0 else range(n - 1)


def walk(names: Sequence[str], counts):
    """(order, its steps) for every order of the filters of one part."""
    diagram = Diagram(names, counts)
    yield "".join(diagram.order), list(diagram.steps())
    for k in swaps(len(names)):
        diagram.swap(k)
        yield "".join(diagram.order), list(diagram.steps())


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Counts per (part, mask): at most 32 rows per part.

    Bits of the mask are the filters A to E in turn. E: the text is that of a smaller
    doc_id anywhere in the table. A null text is empty, a null part the empty string.
    A null doc_id is no smaller than any, has no label, and fails E where its text has
    a doc_id; rows that share the smallest doc_id all pass E. A document is good (toxic)
    if any of its label rows says 1. An empty table gives no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit(""))
                       .alias("part"), body("text").alias("_text")).withColumn("_words", words(F.col("_text")))
    rules = text_rules()
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(rules.values())), F.lit(0))
    # texts go no further than their digest
    told = read.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest"),
                       F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.xxhash64("_text")).alias("at"))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("at")).agg(
        *[F.max((F.col(c) == 1).cast("int")).alias(t) for c, t in (("quality", "good"), ("toxic", "toxic"))]
    ).withColumn("named", F.lit(True))
    known = told.join(marked, ["at", "named"], "left")
    # one row per text, part and doc_id, then per text and part, then per text: however
    # many copies a text has, few rows of it meet
    one = ["digest", "part", "mask"]
    each = known.groupBy(*one, "at", "named", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *COUNTS))
    texts = each.groupBy(*one).agg(first.alias("first"), *[F.sum(c).alias(c) for c in COUNTS])
    # a group without any doc_id holds no copy of a smaller one: all its rows pass
    passing = [F.when(F.col("first.none"), F.col(c)).otherwise(F.col(f"first.{c}")).alias(f"p_{c}") for c in COUNTS]
    texts = stable(texts.select(*one, F.col("first.doc_id").alias("least"), *passing, *COUNTS), "texts")
    least = texts.groupBy("digest").agg(F.min("least").alias("l"), F.count(F.lit(1)).alias("parts"))
    # a text of a single part needs no second look
    wide = least.filter("parts > 1").select("digest", "l")
    both = texts.join(wide, "digest", "left")
    passed = [F.when(F.col("l").isNull() | F.col("least").eqNullSafe(F.col("l")), F.col(f"p_{c}")).otherwise(0).alias(f"p_{c}")
              for c in COUNTS]
    split = both.select("part", "mask", *COUNTS, *passed)
    cells = F.array(F.struct(F.col("mask"), *[F.col(f"p_{c}").alias(c) for c in COUNTS]),
                    F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(rules))).alias("mask"),
                             *[(F.col(c) - F.col(f"p_{c}")).alias(c) for c in COUNTS]))
    return (split.select("part", F.inline(cells)).groupBy("part", "mask")
            .agg(*[F.sum(c).alias(c) for c in COUNTS]).filter("n > 0"))


def audit(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from :func:`masks`.

    ``kept`` and ``removed`` after and by this step; ``redundant`` fails its filter but
    went before; ``unique_fails`` fails its filter only; ``good_lost``, ``toxic_lost``
    of the removed; ``shapley`` is what its filter removes, summed over all orders. A
    part's masks, 2 ** filters at most, are its whole diagram.
    """
    def one(part: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): v for m, v in zip(part["mask"], part[list(COUNTS)].to_numpy(np.int64))}
        rows, failing, alone, total = [], {}, {}, dict.fromkeys(names, 0)
        for order, steps in walk(names, counts):
            for step, (name, kept, removed) in enumerate(steps, 1):
                rows.append((part["part"].iloc[0], order, step, name, kept[0], *removed))
                total[name] += removed[0]
                if step == 1:
                    failing[name] = removed[0]
                if step == len(names):  # all others pass on the way here
                    alone[name] = removed[0]
        return pd.DataFrame([(p, order, step, kept, gone, failing[f] - gone, alone[f], good, toxic, total[f])
                             for p, order, step, f, kept, gone, good, toxic in rows], columns=columns)

    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
               "toxic_lost", "shapley"]
    return counted.groupBy("part").applyInPandas(one, ", ".join(
        ["part string", "filter_order string", "step int", *(f"{c} long" for c in columns[3:])]))

