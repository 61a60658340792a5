"""Shapley values of boosted trees against brute force over all feature subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from martloom.operators import shapley

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(400).select("id", *[((F.col("id") * k) % m).cast("double").alias(n)
                                        for n, k, m in (("a", 37, 11), ("b", 53, 7), ("c", 29, 5))])
    return x.withColumn("label", F.col("a") * 2 + F.when(F.col("b") > 3, F.col("c") * 3).otherwise(1.0)).cache()


def expected(nodes, x, known, at=0):
    """Mean prediction of a tree when only the ``known`` features are followed."""
    feature, threshold, left, right, value, n = nodes[at]
    if left < 0:
        return value
    if feature in known:
        return expected(nodes, x, known, left if x[feature] <= threshold else right)
    return sum(nodes[c][5] / n * expected(nodes, x, known, c) for c in (left, right))


def brute(forest, x):
    out, k = np.zeros(3), 3
    for i in range(k):
        others = [j for j in range(k) if j != i]
        for size in range(k):
            for some in combinations(others, size):
                odds = factorial(size) * factorial(k - size - 1) / factorial(k)
                out[i] += odds * sum(w * (expected(t, x, {*some, i}) - expected(t, x, set(some))) for w, t in forest)
    return out


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_values_add_up_and_are_exact(spark, rows, kind):
    learner = (GBTRegressor(maxIter=12, maxDepth=4, seed=1) if kind == "boosted" else
               RandomForestRegressor(numTrees=8, maxDepth=5, seed=1))
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    model = learner.fit(data)
    forest = shapley.forest_of(model)
    if kind == "forest":
        forest = [(1 / len(forest), t) for _, t in forest]
    scored = {r.id: r for r in model.transform(data).collect()}
    got = shapley.shapley_values(rows, forest, NAMES, ["id"]).collect()
    assert len(got) == 400
    for r in got:
        assert r.base + sum(r.shap) == pytest.approx(scored[r.id].prediction, abs=1e-9)
    for r in got[::40]:
        x = [scored[r.id][n] for n in NAMES]
        assert np.allclose(r.shap, brute(forest, x), atol=1e-9)
    mean = {r.feature: r.mean_abs_shap for r in shapley.mean_absolute(rows.repartition(5), forest, NAMES).collect()}
    want = np.abs([r.shap for r in got]).mean(0)
    assert np.allclose([mean[n] for n in NAMES], want)


def test_unknown_features_go_right(spark, rows):
    data = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(rows)
    model = GBTRegressor(maxIter=4, maxDepth=3, seed=1).fit(data)
    odd = spark.createDataFrame([(1, None, 2.0, None), (2, float("nan"), 2.0, float("nan"))],
                                "id long, a double, b double, c double")
    one, two = shapley.shapley_values(odd, shapley.forest_of(model), NAMES, ["id"]).orderBy("id").collect()
    assert one.shap == two.shap
    scored = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(odd.filter("id = 2"))
    assert two.base + sum(two.shap) == pytest.approx(model.transform(scored).first().prediction, abs=1e-9)
    assert shapley.shapley_values(odd.limit(0), shapley.forest_of(model), NAMES).count() == 0
    assert all(r.mean_abs_shap is None for r in shapley.mean_absolute(odd.limit(0), shapley.forest_of(model), NAMES).collect())


def test_leaf_tables_take_all_cases_together(monkeypatch):
    """No appending case by case, which took the driver minutes for 400 trees."""
    calls = []
    monkeypatch.setattr(np, "append", lambda *a: calls.append(a) or np.concatenate([np.ravel(a[0]), np.ravel(a[1])]))
    nodes = {0: (0, 1.0, 1, 2, 0.0, 10.0), 1: (1, 2.0, 3, 4, 0.0, 4.0), 2: (0, None, -1, -1, 5.0, 6.0),
             3: (0, None, -1, -1, 1.0, 1.0), 4: (0, None, -1, -1, 2.0, 3.0)}
    got = shapley.Tables([(1.0, nodes)], 3).values(np.array([[0.0, 3.0, 0.0], [2.0, 0.0, 0.0]]))
    assert np.allclose(got, [brute([(1.0, nodes)], x) for x in ([0.0, 3.0, 0.0], [2.0, 0.0, 0.0])])
    assert not calls
