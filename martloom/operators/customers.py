"""Customer segmentation and churn.

Everything is keyed by customer; orders are reduced to one row per customer
by a combinable aggregate before anything else happens.
"""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import bin_fixed, half_even, money, rfm_segment
from .aggregate import share_of_total
from .order import rank_quintile, top_k, value_quintile
from .stable import stable


def rfm(orders: DataFrame, customer: str = "customer_key", date: str = "full_date",
        amount: str = "gross_amount") -> DataFrame:
    """Recency, frequency, monetary value, their quintile scores and a segment.

    The as-of date is the newest order. Recency is scored on its values and
    reversed; frequency and monetary are scored on exact ranks with ties
    broken by the customer key.
    """
    known = orders.filter(F.col(customer).isNotNull())
    asof = orders.agg(F.max(date).alias("d")).scalar()
    base = known.groupBy(F.col(customer).alias("customer_key")).agg(
        F.min(date).alias("first_order"), F.max(date).alias("last_order"),
        F.count(F.lit(1)).alias("frequency"), F.sum(amount).alias("monetary"))
    base = stable(base.withColumn("recency_days", F.datediff(asof, "last_order"))
                  .withColumn("tenure_days", F.datediff(asof, "first_order")), "rfm")
    scored = value_quintile(base, "recency_days", "r_score", reverse=True, small_domain=True)
    scored = rank_quintile(scored, "frequency", ["customer_key"], "f_score")
    scored = rank_quintile(scored, "monetary", ["customer_key"], "m_score")
    return scored.select(
        "customer_key", "first_order", "last_order", "recency_days", "tenure_days",
        "frequency", money("monetary").alias("monetary"),
        half_even(F.col("monetary").cast("double") / F.col("frequency"), 2)
        .alias("avg_order_value"),
        "r_score", "f_score", "m_score",
        (F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")).alias("rfm_score"),
        rfm_segment("r_score", "f_score").alias("segment"))


def segment_summary(rfm_table: DataFrame) -> DataFrame:
    per = rfm_table.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), money(F.sum("monetary")).alias("revenue"),
        F.round(F.avg("frequency"), 4).alias("avg_orders"))
    return share_of_total(per, "revenue", "revenue_share_pct", scale=100, places=1)


def churn_features(orders: DataFrame, customer: str = "customer_key",
                   date: str = "full_date", amount: str = "gross_amount",
                   delivery: str = "is_delivery", outcome_days: int = 60) -> DataFrame:
    """Features from orders up to the cutoff, label from orders after it.

    One aggregate serves both windows: feature expressions see only rows up
    to ``max(date) - outcome_days``, the label only rows after it.
    """
    cutoff = orders.agg(F.date_sub(F.max(date), outcome_days).alias("c")).scalar()
    seen = F.col("_seen")
    value = F.when(seen, F.col(amount))
    feat = (orders.filter(F.col(customer).isNotNull())
            .withColumn("_seen", F.col(date) <= cutoff)
            .groupBy(F.col(customer).alias("customer_key")).agg(
                F.count_if(seen).alias("frequency"), money(F.sum(value)).alias("monetary"),
                F.max(F.when(seen, F.col(date))).alias("_last"),
                F.min(F.when(seen, F.col(date))).alias("_first"),
                F.avg(F.when(seen, F.col(delivery).cast("int"))).alias("delivery_share"),
                F.bool_or(~seen).cast("int").alias("returned"))
            .filter(F.col("frequency") > 0))
    feat = (feat.withColumn("recency_days", F.datediff(cutoff, "_last"))
            .withColumn("tenure_days", F.datediff(cutoff, "_first")))
    feat = feat.withColumn("avg_order_value",
                           F.col("monetary").cast("double") / F.col("frequency"))
    months = F.greatest(F.col("tenure_days") / F.lit(30.0), F.lit(1.0))
    return feat.select("customer_key", *V.CHURN_FEATURES[:5],
                       (F.col("frequency") / months).alias("orders_per_month"),
                       "delivery_share", "returned")


def hash_split(df: DataFrame, key: str, share: float, by: Sequence[str] = ()):
    """(train, test) by key hash: the same rows whatever the partitioning.

    With ``by`` the key is hashed together with the class, so each class is
    divided in the same proportion up to hashing.
    """
    spot = F.pmod(F.xxhash64(F.lit(42), *by, key), F.lit(1000))
    return df.filter(spot < int(share * 1000)), df.filter(spot >= int(share * 1000))


def churn_model(features: DataFrame, max_iter: int = 200, step: float = 0.08,
                seed: int = 42, columns: Sequence[str] = tuple(V.CHURN_FEATURES)):
    """(every customer scored and banded, ROC-AUC on the held-out quarter)."""
    vec = VectorAssembler(inputCols=list(columns), outputCol="features",
                          handleInvalid="keep")
    numeric = features.withColumns({c: F.col(c).cast("double") for c in columns})
    data = stable(vec.transform(numeric.withColumn(
        "label", (1 - F.col("returned")).cast("double"))), "churn")
    train, test = hash_split(data, "customer_key", 0.75, ["label"])
    model = GBTClassifier(maxIter=max_iter, stepSize=step, seed=seed).fit(train)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(
        model.transform(test))
    return churn_bands(model.transform(data).withColumn(
        "churn_probability", vector_to_array("probability")[1])), float(auc)


def churn_bands(scored: DataFrame) -> DataFrame:
    """Final churn columns from features plus ``churn_probability``."""
    p = half_even("churn_probability", 4)
    return scored.select(
        "customer_key", F.col("frequency").cast("long").alias("frequency"),
        money("monetary").alias("monetary"),
        half_even("avg_order_value", 2).alias("avg_order_value"),
        F.col("recency_days").cast("int").alias("recency_days"),
        F.col("tenure_days").cast("int").alias("tenure_days"),
        half_even("orders_per_month", 2).alias("orders_per_month"),
        p.alias("churn_probability"),
        bin_fixed(p, V.CHURN_BAND_EDGES, V.CHURN_BANDS).alias("risk_band"))


def winback_list(churn: DataFrame, k: int = 50, band: str = "High") -> DataFrame:
    return top_k(churn.filter(F.col("risk_band") == band).select(
        "customer_key", "frequency", "monetary", "avg_order_value", "recency_days",
        "churn_probability"), [F.col("monetary").desc(), "customer_key"], k)


def band_value(churn: DataFrame) -> DataFrame:
    return churn.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("customers"), money(F.sum("monetary")).alias("historic_value"))
