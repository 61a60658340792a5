"""Exact Shapley values of boosted trees, path-dependent: a feature that is left
out follows both branches of its splits in proportion to the training rows there.

A leaf's share in a value depends only on which of the features on its path lead a
row to it, 2 ** depth cases at most, so each leaf has a table of its shares. A row
then costs its split comparisons and one look-up per leaf, a batch at a time.
"""

from collections.abc import Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .stable import scratch_path


def forest_of(model) -> list:
    """Every tree of a fitted Spark gradient-boosted or forest regressor as
    (weight, {node id: (feature, threshold, left, right, value, rows)}), from the
    model's own stored form."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    trees, n = {}, "nodeData"
    # nodes of the model: trees x 2 ** (depth + 1) at most
    for r in spark.read.parquet(f"{path}/data").select(
            "treeID", f"{n}.id", f"{n}.prediction", f"{n}.impurityStats", f"{n}.leftChild", f"{n}.rightChild",
            f"{n}.split.featureIndex", f"{n}.split.leftCategoriesOrThreshold", f"{n}.split.numCategories").collect():
        if r.leftChild >= 0 and r.numCategories >= 0:
            raise ValueError("a split over categories has no threshold")
        trees.setdefault(r.treeID, {})[r.id] = (
            r.featureIndex, r.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else None, r.leftChild, r.rightChild,
            r.prediction, r.impurityStats[0])
    return [(w, trees[t]) for t, w in enumerate(model.treeWeights)]


class Tables:
    """The leaves of all trees with their share tables."""

    def __init__(self, forest, n_features):
        self.n_features, self.base, self.trees = n_features, 0.0, []
        for weight, nodes in forest:
            splits, leaves = {}, []  # splits: (feature, threshold) to a number
            self._walk(nodes, 0, [], 1.0, splits, leaves, weight)
            self.trees.append((list(splits), leaves))

    def _walk(self, nodes, at, path, share, splits, leaves, weight):
        feature, threshold, left, right, value, rows = nodes[at]
        if left < 0:
            self.base += weight * value * share
            leaves.append(self._leaf(path, weight * value))
            return
        number = splits.setdefault((feature, threshold), len(splits))
        for child, goes in ((left, True), (right, False)):
            part = nodes[child][5] / rows if rows else 0.0
            self._walk(nodes, child, [*path, (feature, number, goes, part)], share * part, splits, leaves, weight)

    def _leaf(self, path, value):
        """(features, their conditions as (split, side) lists, shares by case)."""
        features = list(dict.fromkeys(f for f, *_ in path))
        conditions = [[(n, goes) for f, n, goes, _ in path if f == g] for g in features]
        parts = [float(np.prod([p for f, _, _, p in path if f == g])) for g in features]
        k = len(features)
        table = np.zeros((1 << k, k))
        leads = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(float)  # all cases at once
        odds = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)])
        for i in range(k):
            # coefficients: sums over the other features' subsets of each size
            sizes, n = np.zeros((1 << k, k)), 1
            sizes[:, 0] = 1.0
            for j in range(k):
                if j != i:
                    longer = sizes * parts[j]
                    longer[:, 1:n + 1] += sizes[:, :n] * leads[:, j:j + 1]
                    sizes, n = longer, n + 1
            table[:, i] = value * (leads[:, i] - parts[i]) * (sizes @ odds)
        return features, conditions, table

    def values(self, x):
        """Shapley values of the rows of ``x``, a column per feature."""
        out = np.zeros((len(x), self.n_features))
        for splits, leaves in self.trees:
            left = [x[:, f] <= t for f, t in splits]
            right = [~b for b in left]
            for features, conditions, table in leaves:
                case = np.zeros(len(x), np.int64)
                for j, both in enumerate(conditions):
                    met = None
                    for number, goes in both:
                        side = (left if goes else right)[number]
                        met = side if met is None else met & side
                    case |= met.astype(np.int64) << j
                if features:
                    out[:, features] += table[case]
        return out


def shapley_values(rows: DataFrame, forest, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``base`` (the mean prediction) and ``shap``, an array with one value
    per feature; base and values add up to the prediction. A null feature counts as
    NaN, which goes right as it does in the model."""
    tables, features, keep = Tables(forest, len(features)), list(features), list(keep)
    read = rows.select(*keep, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
                       .alias("_x"))

    def run(batches):
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            shap = [*tables.values(x)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(np.full(len(x), tables.base)),
                                   pa.array([s.tolist() for s in shap], pa.list_(pa.float64()))], [*keep, "base", "shap"])

    schema = read.drop("_x").schema.add("base", T.DoubleType()).add("shap", T.ArrayType(T.DoubleType()))
    return read.mapInArrow(run, schema)


def mean_absolute(rows: DataFrame, forest, features: Sequence[str], weight: str | None = None) -> DataFrame:
    """(feature, mean_abs_shap) over all ``rows``, each as often as its ``weight`` says;
    tasks hand on sums only."""
    tables, features = Tables(forest, len(features)), list(features)
    read = rows.select(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).alias("x"),
                       (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def run(batches):
        total, n = np.zeros(len(features)), 0.0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            w = batch.column("w").to_numpy(zero_copy_only=False)
            total, n = total + w @ np.abs(tables.values(x)), n + w.sum()
        yield pa.record_batch([pa.array(features), pa.array(total), pa.array([n] * len(features), pa.float64())],
                              ["feature", "s", "n"])

    return read.mapInArrow(run, "feature string, s double, n double").groupBy("feature").agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("mean_abs_shap"))
