"""Data-quality gates. Each returns rows that say what is wrong; ``require``
turns any finding into an error."""

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as V
from ..functions.numeric import col
from .combine import missing_keys, unpivot_lines

INTEGERS = {"byte", "short", "integer", "long"}
FLOATS = {"float", "double", "decimal"}


class QualityError(ValueError):
    pass


def require(findings: DataFrame, what: str, show: int = 5) -> None:
    rows = findings.take(show)
    if rows:
        raise QualityError(f"{what}: {[r.asDict() for r in rows]}")


def plausibility_metrics(orders: DataFrame, shifts: DataFrame) -> DataFrame:
    """The seven branch metrics as one row; note that labour is of net here."""
    trip = F.col("is_delivery")
    day = orders.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross_amount").alias("gross"),
        F.sum("net_revenue").alias("net"), F.sum("food_cost").alias("food"),
        F.count(F.when(trip, F.col("is_late"))).alias("judged"),
        F.count_if(trip & F.col("is_late")).alias("late"),
        F.sum(F.when(trip, F.col("actual_min"))).alias("minutes"),
        F.count(F.when(trip, F.col("actual_min"))).alias("timed"))
    o = day.agg(F.count(F.lit(1)).alias("days"),
                *[F.sum(c).cast("double").alias(c) for c in day.columns if c != "date_key"])
    buckets = ["labour_cost", "waste_eur", "packaging_cost", "payment_fees", "fixed_cost",
               "royalty_cost"]
    s = shifts.agg(*[F.sum(c).cast("double").alias(c) for c in buckets])
    # two one-row totals become one row
    both = o.unionByName(s, allowMissingColumns=True)
    t = both.agg(*[F.max(c).alias(c) for c in both.columns])
    cost = F.col("food")
    for c in buckets:
        cost = cost + F.coalesce(c, F.lit(0.0))
    return t.select(
        F.try_divide("gross", "n").alias("aov_eur"),
        F.try_divide("n", F.col("days").cast("double")).alias("orders_per_day"),
        (F.try_divide("late", "judged") * 100).alias("late_pct"),
        F.try_divide("minutes", "timed").alias("delivery_min"),
        (F.try_divide("food", "gross") * 100).alias("food_cost_pct"),
        (F.try_divide("labour_cost", "net") * 100).alias("labour_cost_pct"),
        (F.try_divide(F.col("net") - cost, F.col("net")) * 100).alias("operating_margin_pct"))


def plausibility_gate(metrics: DataFrame, ranges: Mapping = V.PLAUSIBLE) -> DataFrame:
    """PASS / FAIL per metric against inclusive ranges; NULL fails."""
    rows = unpivot_lines(metrics, {m: F.col(m).cast("double") for m in ranges},
                         "metric", "value")
    low = F.create_map(*[F.lit(x) for m, (lo, _) in ranges.items() for x in (m, float(lo))])
    high = F.create_map(*[F.lit(x) for m, (_, hi) in ranges.items() for x in (m, float(hi))])
    out = rows.withColumn("low", low[F.col("metric")]).withColumn(
        "high", high[F.col("metric")])
    ok = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def effect_frame(daily: DataFrame, hot_above=V.HOT_ABOVE_C) -> DataFrame:
    """Orders per day with 0/1 effects; needs the calendar columns."""
    def flag(c):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    return daily.select(
        "full_date", F.log(F.col("orders").cast("double")).alias("log_orders"),
        flag(F.col("is_rainy")).alias("rainy"),
        flag(F.col("temp_max_c") > hot_above).alias("hot"),
        flag(F.col("is_cold")).alias("cold"), flag(F.col("is_public_holiday")).alias("ph"),
        flag(F.col("is_school_holiday")).alias("sh"), "day_of_week", "month")


def effect_recovery(frame: DataFrame, effects: Sequence[str] = ("rainy", "hot", "cold",
                                                                "ph", "sh"),
                    factors: Mapping[str, Sequence[int]] | None = None,
                    target: str = "log_orders", alpha: float = 0.05) -> DataFrame:
    """OLS of log orders on the effects, with weekday and month held constant.

    One row per effect: exp(beta) - 1, p-value, verdict, R2 and day count.
    """
    factors = factors or {"day_of_week": range(2, 8), "month": range(2, 13)}
    dummies = {f"{c}={v}": (F.col(c) == v).cast("double")
               for c, levels in factors.items() for v in levels}
    wide = frame.select(F.col(target).alias("label"), *effects,
                        *[e.alias(n) for n, e in dummies.items()])
    # a constant column would make the normal equations singular
    spread = wide.agg(*[F.stddev_pop(F.col(f"`{c}`")).alias(c)
                        for c in [*effects, *dummies]]).first()
    used = [c for c in [*effects, *dummies] if spread[c]]
    data = VectorAssembler(inputCols=used, outputCol="features").transform(wide)
    fit = LinearRegression(solver="normal", standardization=False).fit(data)
    p, n, r2 = fit.summary.pValues, fit.summary.numInstances, fit.summary.r2
    rows = []
    for e in effects:
        at = used.index(e) if e in used else None
        beta = float(fit.coefficients[at]) if at is not None else None
        rows.append((e, beta, float(p[at]) if at is not None else None))
    names, betas, ps = zip(*rows)
    table = frame.sparkSession.createDataFrame(pa.table({
        "effect": pa.array(names), "beta": pa.array(betas, pa.float64()),
        "p_value": pa.array(ps, pa.float64())}))
    return table.select(
        "effect", (F.exp("beta") - 1).alias("recovered"), "p_value",
        F.when(F.col("p_value") < alpha, "identified").otherwise("NOT identifiable")
        .alias("verdict"), F.lit(float(r2)).alias("r2"), F.lit(int(n)).alias("days"))


def check_unique(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Keys that occur more than once."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_fk(df: DataFrame, fk: str, ref: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent and how often each occurs.

    Keys are counted first, so a frequent key is one row in the join; NULL
    keys are allowed.
    """
    used = (df.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("fk"))
            .agg(F.count(F.lit(1)).alias("n")))
    return used.join(ref.select(F.col(key).alias("fk")).distinct(), "fk", "left_anti")


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per named rule in one scan; NULL counts as a violation."""
    bad = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n)
                   for n, r in rules.items()])
    return unpivot_lines(bad, {n: F.col(n) for n in rules}, "rule", "violations")


def check_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """One row per column that would not load into ``schema``.

    A fractional type may feed an integer column when every value is whole;
    that is measured in one aggregate over such columns.
    """
    target = {f.name: f.dataType.typeName() for f in schema.fields}
    issues, measured = [], []
    for f in df.schema.fields:
        have, want = f.dataType.typeName(), target.get(f.name)
        if want is None:
            issues.append((f.name, "not in schema"))
        elif want in INTEGERS and have in FLOATS:
            measured.append((f.name, want))
        elif (want in INTEGERS and have not in INTEGERS) or (
                want == "boolean" and have != "boolean"):
            issues.append((f.name, f"{have} -> {want}"))
    for n in target:
        if n not in df.columns:
            issues.append((n, "missing"))
    if measured:
        broken = df.agg(*[F.count_if(F.col(n) != F.floor(F.col(n))).alias(n)
                          for n, _ in measured]).first()
        issues += [(n, f"{broken[n]} fractional values -> {w}")
                   for n, w in measured if broken[n]]
    return df.sparkSession.createDataFrame(pa.table({
        "column_name": pa.array([i[0] for i in issues], pa.string()),
        "issue": pa.array([i[1] for i in issues], pa.string())}))


def entry_rules(entries: DataFrame, aov_range=V.ENTRY_AOV_RANGE) -> DataFrame:
    """Adds ``is_blocked`` (an open day with neither orders nor revenue must
    not be saved) and ``warnings`` (odd, but saved)."""
    orders, revenue = F.col("total_orders"), F.col("gross_revenue")
    open_ = ~F.col("is_closed")
    aov = F.try_divide(revenue.cast("decimal(22,2)"), orders.cast("decimal(22,2)"))
    found = [
        (F.col("delivery_orders") + F.col("pickup_orders") != orders, "split_mismatch"),
        ((orders > 0) & open_ & ~aov.between(*aov_range), "order_value_unusual"),
        ((orders > 0) & (revenue == 0), "orders_without_revenue"),
        ((F.col("staff_hours") == 0) & (orders > 0), "orders_without_hours")]
    notes = F.array(*[F.when(c, n) for c, n in found])
    return (entries
            .withColumn("is_blocked", open_ & (orders == 0) & (revenue == 0))
            .withColumn("warnings", F.filter(notes, lambda w: w.isNotNull())))


def missing_days(entries: DataFrame, today, back: int = 14,
                 date: str = "business_date") -> DataFrame:
    """Days without an entry in the ``back`` days that end yesterday, never
    before the first entry."""
    first = entries.agg(F.min(date).alias("d")).scalar()
    now = F.lit(today).cast("date")
    days = entries.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(now, back), F.date_sub(now, 1))).alias(date))
    recent = entries.filter(F.col(date).between(F.date_sub(now, back), F.date_sub(now, 1)))
    return missing_keys(days.filter(F.col(date) >= first), recent, date)


def freshness(actuals: DataFrame, today, date: str = "business_date") -> DataFrame:
    """Days recorded, by source, the gap to today and whether it is stale."""
    gap = F.datediff(F.lit(today).cast("date"), F.max(date))
    return actuals.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("source") == "history").alias("from_history"),
        F.count_if(F.col("source") == "form").alias("from_form"),
        gap.alias("gap_days"), (gap > 1).alias("is_stale"))


def demand_drivers(frame: DataFrame) -> DataFrame:
    """Effects on demand, strongest first."""
    return effect_recovery(frame).orderBy(F.abs("recovered").desc_nulls_last(), "effect")


def reconcile(source: DataFrame, loaded: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Row counts and column sums on both sides of a load."""
    def side(df, tag):
        return df.agg(F.count(F.lit(1)).cast("decimal(38,4)").alias("rows"), *[
            F.sum(col(c)).cast("decimal(38,4)").alias(c) for c in sums]).select(
                F.lit(tag).alias("_side"), "*")
    names = ["rows", *sums]
    both = side(source, "source").unionByName(side(loaded, "loaded"))
    long = both.unpivot("_side", names, "measure", "value")
    return long.groupBy("measure").agg(
        F.max(F.when(F.col("_side") == "source", F.col("value"))).alias("source"),
        F.max(F.when(F.col("_side") == "loaded", F.col("value"))).alias("loaded")).withColumn(
            "matches", F.col("source").eqNullSafe(F.col("loaded")))
