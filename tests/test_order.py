"""Ranks, quantiles and quintiles against pandas, with a hot value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martloom.operators import aggregate, order
from helpers import table


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one group and one value."""
    df = spark.range(3000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 0, 5).otherwise((F.col("id") * 7919) % 101).alias("v"))
    return df, df.toPandas()


def test_global_rank(skewed):
    df, pdf = skewed
    got = order.global_rank(df, ["v", "k"]).toPandas().sort_values("rank")
    want = pdf.sort_values(["v", "k"])
    assert got["rank"].tolist() == list(range(1, 3001))
    assert got["k"].tolist() == want["k"].tolist()


def test_global_rank_in_groups(skewed):
    df, pdf = skewed
    got = order.global_rank(df, [F.col("v").desc(), "k"], by=["g"]).toPandas().set_index("k")
    want = pdf.sort_values(["v", "k"], ascending=[False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    assert (got["rank"].sort_index() == want.set_index("k")["rank"].sort_index()).all()


def test_running_total(skewed):
    df, pdf = skewed
    got = order.running_total(df, ["v", "k"], "v", "run", ["g"]).toPandas().set_index("k")["run"]
    want = pdf.sort_values(["v", "k"]).set_index("k").groupby("g")["v"].cumsum()
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("how", [{}, {"few": 20}, {"wide_domain": True}, {"small_domain": True}])
def test_quantiles(skewed, how):
    df, pdf = skewed
    got = aggregate.group_quantiles(df, ["g"], "v", [0.5, 0.8, 0.95], ["a", "b", "c"], **how).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.5, 0.8, 0.95]).unstack().sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_narrowed_quantiles_of_odd_groups(spark):
    """Ties over the wanted rank, values of any size, one row, null keys and values."""
    r = np.random.default_rng(1)
    groups = {"tied": [5.0] * 3000 + [1.0] * 10, "wide": [10.0 ** e for e in r.uniform(-300, 300, 4000)],
              "signed": r.normal(size=5000).tolist(), "one": [7.0], None: r.normal(size=2500).round(1).tolist(),
              "few": [1.0, 2.0], "split": [0.0] * 2000 + [9.0] * 2000}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for few in (50, 100_000):
        got = {x.g: list(x)[1:] for x in aggregate.group_quantiles(df, ["g"], "v", probs, list("abcde"), few=few).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-12), (g, few)
    assert aggregate.group_quantiles(df.limit(0), ["g"], "v", probs, list("abcde")).count() == 0


@pytest.mark.parametrize("few", [30, 100_000])
def test_quantiles_need_no_percentile(spark, few):
    """Neither plan holds a group's values in an aggregate buffer."""
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7.5).alias("v"))
    got = aggregate.group_quantiles(df, ["g"], "v", [0.5], few=few)
    assert "percentile(" not in got._jdf.queryExecution().executedPlan().toString()


def test_quantiles_without_groups(skewed):
    df, pdf = skewed
    got = aggregate.group_quantiles(df, [], "v", [0.37], ["q"], wide_domain=True).first()["q"]
    assert got == pytest.approx(pdf["v"].quantile(0.37))


def test_rank_quintile_equals_qcut_on_ranks(spark):
    for n in (1, 2, 5, 7, 23, 200):
        pdf = pd.DataFrame({"k": range(n), "v": [(i * 37) % 5 for i in range(n)]})
        df = spark.createDataFrame(pdf)
        got = order.rank_quintile(df, "v", ["k"], "s").toPandas().sort_values("k")["s"].tolist()
        if n == 1:
            assert got == [1]
            continue
        rank = pdf["v"].rank(method="first")
        want = pd.qcut(rank, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
        assert got == want, n


def test_seven_tied_rows_split_2_1_1_1_2(spark):
    df = table(spark, "k long, v long", *[(i, 3) for i in range(7)])
    got = order.rank_quintile(df, "v", ["k"], "s").groupBy("s").count().collect()
    assert sorted((r["s"], r["count"]) for r in got) == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 2)]


def test_value_quintile(spark):
    values = [(i * 7919) % 97 for i in range(60)]
    df = table(spark, "k long, v long", *enumerate(values))
    got = order.value_quintile(df, "v", "s", reverse=True).toPandas().sort_values("k")["s"]
    want = pd.qcut(pd.Series(values), 5, labels=[5, 4, 3, 2, 1]).astype(int)
    assert got.tolist() == want.tolist()
    # repeated edges merge instead of raising
    flat = table(spark, "k long, v long", *[(i, 1) for i in range(9)], (9, 50))
    got = order.value_quintile(flat, "v", "s").toPandas()
    assert set(got["s"]) <= {1, 2, 3, 4, 5}


def test_top_k_is_numbered(skewed):
    df, pdf = skewed
    got = order.top_k(df, [F.col("v").desc(), "k"], 5, "n").collect()
    want = pdf.sort_values(["v", "k"], ascending=[False, True]).head(5)["k"].tolist()
    assert [r["k"] for r in got] == want and [r["n"] for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_surrogate_keys_with_many_copies(spark, chunk):
    """A third of all rows are exact copies of one row."""
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 4).otherwise(F.col("id") % 11).alias("a"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5).alias("b"))
    got = order.surrogate_keys(df, ["a", "b"], "key", chunk).toPandas().sort_values("key")
    want = df.toPandas().sort_values(["a", "b"])
    assert got["key"].tolist() == list(range(1, 901))
    assert got[["a", "b"]].to_numpy().tolist() == want.to_numpy().tolist()
