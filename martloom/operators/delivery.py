"""Delivery times: what drives them and what each zone can promise."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import half_even, safe_ratio, value_map
from .aggregate import group_quantiles
from .customers import hash_split
from .order import number_rows
from .shapley import forest_of, mean_absolute
from .stable import stable


def delivery_frame(orders: DataFrame, zones: DataFrame, calendar: DataFrame,
                   daily: DataFrame) -> DataFrame:
    """Timed deliveries with zone, calendar and day-load columns.

    ``daily`` holds (date_key, orders). An unknown daypart codes to 0.
    """
    timed = orders.filter(F.col("is_delivery") & F.col("actual_min").isNotNull())
    return (timed.select("order_key", "zone_key", "date_key", "daypart", "item_qty",
                         "actual_min", "is_late")
            .join(zones.select("zone_key", "plz", "district_name", "distance_km",
                               "base_drive_min"), "zone_key")
            .join(calendar.select("date_key", "full_date", "day_of_week", "is_rainy",
                                  "temp_mean_c", "precipitation_mm"), "date_key")
            .join(daily.select("date_key", F.col("orders").alias("orders_that_day")),
                  "date_key")
            .withColumn("daypart_code", value_map("daypart", V.DAYPART_CODES, 0))
            .withColumn("is_rainy", F.coalesce(F.col("is_rainy").cast("int"), F.lit(0))))


def promise_times(deliveries: DataFrame, level: float = 0.80, step: int = 5,
                  current: int = 45) -> DataFrame:
    """Per zone, the promise that would be kept ``level`` of the time, rounded
    up to the next ``step`` minutes.

    Minutes repeat a lot, so a zone shuffles one counter per distinct minute,
    however many deliveries it has. The recommendation uses the unrounded
    quantile, freed from float drift.
    """
    zone = ["zone_key", "plz", "district_name", "distance_km"]
    stats = deliveries.groupBy(*zone).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("actual_min").alias("_avg"),
        (F.avg(F.col("is_late").cast("int")) * 100).alias("_late"))
    q = group_quantiles(deliveries, ["zone_key"], "actual_min", [level, 0.95],
                        ["_level", "_p95"], small_domain=True)
    exact = F.round("_level", 9)
    return stats.join(q, "zone_key").select(
        *zone, "orders", half_even("_avg", 1).alias("avg_min"),
        half_even(exact).cast("int").alias("p80_min"),
        half_even(F.round("_p95", 9)).cast("int").alias("p95_min"),
        half_even("_late", 1).alias("current_late_pct"),
        (F.ceil(exact / step) * step).cast("int").alias("recommended_promise_min"),
        F.lit(current).alias("current_promise_min"))


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """Bin limits per feature over all ``rows``, for a Bucketizer: a bin for each value
    where there are at most ``bins`` of them, else quantiles from a mergeable sketch."""
    known = [F.when(~F.isnan(f), F.col(f)).alias(f) for f in features]
    stacked = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), f.alias("v"))
                                             for i, f in enumerate(known)])))
    values = stable(stacked.filter(F.col("v").isNotNull()).distinct(), "values")
    few = values.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= bins)
    points = {i: [] for i in range(len(features))}
    for r in values.join(few, "i").select("i", "v").collect():  # features x bins at most
        points[r.i].append(r.v)
    narrow = {r.i for r in few.collect()}
    wide = [i for i in points if i not in narrow]
    probs = [k / bins for k in range(1, bins)]
    for i, q in zip(wide, rows.agg(*[F.percentile_approx(known[i], probs, 10000).alias(str(i))
                                     for i in wide]).first() if wide else ()):
        points[i] = q or []
    limits = []
    for i, found in points.items():
        inner = sorted(set(found))
        inner = inner[1:] if i in narrow and len(inner) > 1 else inner or [0.0]
        limits.append([float("-inf"), *inner, float("inf")])
    return limits


def binned(bucketizer: Bucketizer, rows: DataFrame, *sums) -> DataFrame:
    """``rows`` counted per vector of bins: as many rows as there are different
    vectors, however many the deliveries, in a partition for each core."""
    names = dict(zip(bucketizer.getInputCols(), bucketizer.getOutputCols()))
    # integers, not the bucketizer's categories
    cells = bucketizer.transform(rows).groupBy(*[F.col(b).cast("int").alias(f) for f, b in names.items()]).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), *sums)
    return stable(cells.repartition(rows.sparkSession.sparkContext.defaultParallelism), "cells")


def delivery_time_model(deliveries: DataFrame,
                        features: Sequence[str] = tuple(V.DELIVERY_FEATURES),
                        trees: int = 400, step: float = 0.05, depth: int = 5,
                        seed: int = 42, bins: int = 32):
    """Boosted regression on a 75/25 key-hash split.

    Trees split between bins, so deliveries in the same bin of every feature stay
    together: each such cell is one training row, its mean as the label and its count as
    the weight, which gives the same squared-error trees as the rows themselves.

    Returns (model, test rows, one-row scores with the model's mean absolute
    error, that of the training mean, and the improvement).
    """
    features = list(features)
    numeric = stable(deliveries.select(
        "order_key", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in features],
        F.col("actual_min").cast("double").alias("label")), "trips")
    train, test = hash_split(numeric, "order_key", 0.75)
    coded = [f"{f}_bin" for f in features]
    bucketizer = Bucketizer(inputCols=features, outputCols=coded, handleInvalid="keep",
                            splitsArray=cut_points(train, features, bins))
    cells = binned(bucketizer, train, F.avg("label").alias("label"))
    # one bin more for unknown values
    fitted = GBTRegressor(maxIter=trees, stepSize=step, maxDepth=depth, seed=seed, maxBins=bins + 1,
                          weightCol="weight").fit(
        VectorAssembler(inputCols=features, outputCol="features").transform(cells))
    model = PipelineModel([bucketizer, VectorAssembler(
        inputCols=coded, outputCol="features", handleInvalid="keep"), fitted])
    mean = train.agg(F.avg("label").alias("m")).scalar()
    scores = model.transform(test).agg(
        F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"),
        F.avg(F.abs(F.col("label") - mean)).alias("naive_mae"))
    return model, test, scores.withColumn(
        "improvement", 1 - F.try_divide("mae", "naive_mae"))


def model_mae(model, test: DataFrame) -> float:
    return RegressionEvaluator(metricName="mae").evaluate(model.transform(test))


def delivery_factors(model, test: DataFrame,
                     features: Sequence[str] = tuple(V.DELIVERY_FEATURES)) -> DataFrame:
    """What drives the minutes of the test rows: the mean absolute Shapley value of
    each feature, its share of all, and its rank. Rows in the same bins have the same
    values, which are found once."""
    cells = binned(model.stages[0], test)
    effect = stable(mean_absolute(cells, forest_of(model.stages[-1]), features, "weight"), "factors").select(
        "feature", half_even("mean_abs_shap", 3).alias("mean_abs_shap"))
    total = effect.agg(F.sum("mean_abs_shap").alias("t")).scalar()
    shared = effect.withColumn("share_of_effect", half_even(F.try_divide(F.col("mean_abs_shap"), total), 4))
    return number_rows(shared, [F.col("mean_abs_shap").desc(), "feature"], "rank")


def late_by_distance(deliveries: DataFrame) -> DataFrame:
    """Late share per distance, the plot behind the zone discussion."""
    return deliveries.groupBy("distance_km").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_late").alias("late")).withColumn(
            "late_pct", safe_ratio("late", "orders", 100, 1))
