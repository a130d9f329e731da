"""Calibration and ranking measures of (label, p) tables, threshold choice, and model fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 5


def reliability(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """One row per bin that has rows: bin (from 1), n, mean_p, rate. A bin holds its upper end, the first also 0."""
    own = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.round(F.col("p") * bins, 9)))).cast("int")
    return rows.groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"))


def calibration_error(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error: the bins' gaps, weighed by their rows."""
    r = reliability(rows, bins)
    return r.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def by_score(rows: DataFrame) -> DataFrame:
    """One row per distinct p: p, n, good. What the curves need of any number of rows."""
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("good"))


def running(scores: DataFrame, parts: int = 64) -> DataFrame:
    """by_score rows with n_before and good_before: the rows of a lower p. Sums run within ranges of p, then over the ranges."""
    ranged = scores.withColumn("range", F.floor(F.col("p") * parts).cast("int"))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("rn"), F.sum("good").alias("rg"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows at most
    sums = sums.select("range", F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("rg").over(before), F.lit(0)).alias("g0"))
    own = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("n1", F.coalesce(F.sum("n").over(own), F.lit(0))).withColumn("g1", F.coalesce(F.sum("good").over(own), F.lit(0)))
    return ranged.join(F.broadcast(sums), "range").select("p", "n", "good", (F.col("n0") + F.col("n1")).alias("n_before"), (F.col("g0") + F.col("g1")).alias("good_before"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """The chance that a positive row is above a negative one, ties counting half; null with one class only."""
    r = running(by_score(rows)).withColumn("bad", F.col("n") - F.col("good")).withColumn("bad_before", F.col("n_before") - F.col("good_before"))
    wins = F.sum((F.col("good") * (F.col("bad_before") + F.col("bad") / 2)).cast("double"))
    pairs = (F.sum("good") * F.sum("bad")).cast("double")
    return r.agg(F.round(F.try_divide(wins, pairs), 6).alias("auc"), F.sum("good").alias("positives"), F.sum("bad").alias("negatives"))


def risk_coverage(rows: DataFrame) -> DataFrame:
    """For each threshold p: the share of rows at or above it, and the share of errors among these."""
    r = running(by_score(rows))
    total = r.agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))
    r = r.join(F.broadcast(total))
    taken, good = F.col("all_n") - F.col("n_before"), F.col("all_good") - F.col("good_before")
    return r.select("p", F.round(taken / F.col("all_n"), 6).alias("coverage"), F.round((taken - good) / taken, 6).alias("risk"), F.col("n").alias("n"))


def best_threshold(rows: DataFrame, risk: float) -> DataFrame:
    """The lowest threshold from which up the risk stays within bounds, and its coverage; the risk below 0.8 coverage beside it."""
    c = risk_coverage(rows)
    ok = F.when(F.col("risk") <= risk, F.struct(F.col("coverage").alias("coverage"), F.col("p").alias("p")))
    return c.agg(F.max(ok).alias("b"), F.max(F.when(F.col("coverage") <= 0.8, F.struct(F.col("coverage").alias("c"), F.col("risk").alias("r")))).alias("e"), F.round(F.sum(F.col("risk") * F.col("n")) / F.sum("n"), 6).alias("aurc")).select(
        F.col("b.p").alias("tau"), F.col("b.coverage").alias("coverage"), F.round(1 - F.col("e.r"), 6).alias("accuracy_at_80"), "aurc"
    )


def resample_weight(*key: str, seed: int) -> Column:
    """How often a row is in a resample (a Poisson law with mean 1), by a hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)


def bootstrap(rows: DataFrame, draws: int = 1000, seed: int = 3) -> DataFrame:
    """metric, low, high, draws: 95 % of the resamples' rate of label, Brier score and accuracy at 0.5. Only sums are shuffled."""
    each = rows.select("id", "label", "p", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", resample_weight("id", "draw", seed=seed))
    mean = lambda x: F.try_divide(F.sum(F.col("w") * x), F.sum("w"))
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("int")
    drawn = each.groupBy("draw").agg(mean(F.col("label")).alias("rate"), mean(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), mean(hit).alias("accuracy"))
    long = drawn.unpivot("draw", ["rate", "brier", "accuracy"], "metric", "x").where("x is not null")
    return long.groupBy("metric").agg(F.round(F.percentile("x", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("x", F.lit(0.975)), 6).alias("high"), F.count(F.lit(1)).alias("draws"))


def answer_errors(rows: DataFrame, taus: list[float]) -> DataFrame:
    """For each threshold: answers that were wrong, of the answered; right ones that were withheld, of the right."""
    t = F.explode(F.array(*map(F.lit, taus))).alias("tau")
    up, good = (F.col("p") >= F.col("tau")).cast("int"), F.col("label")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)), 6)
    return rows.select("label", "p", t).groupBy("tau").agg(share(up * (1 - good), up).alias("false_answers"), share((1 - up) * good, good).alias("false_abstentions"), F.sum(up).alias("answered"))


def fit_logistic(rows: DataFrame, features: list[str], c: float = 1.0) -> DataFrame:
    """Balanced L2 logistic regression on standardised features: one row per feature with its coefficient. rows: label and features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = rows.sparkSession
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    if not stats.n or not 0 < stats.good < stats.n:
        return spark.createDataFrame([], "feature string, coefficient double")
    used = [f for f in features if stats[f"s_{f}"]]  # constant columns go first
    scaled = rows.select("label", F.when(F.col("label") == 1, stats.n / (2 * stats.good)).otherwise(stats.n / (2 * (stats.n - stats.good))).alias("weight"), *[((F.col(f) - stats[f"m_{f}"]) / stats[f"s_{f}"]).alias(f) for f in used])
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1 / (c * stats.n), elasticNetParam=0.0, standardization=False, tol=1e-9, maxIter=200).fit(VectorAssembler(inputCols=used, outputCol="x").transform(scaled))
    return spark.createDataFrame([("intercept", float(model.intercept)), *zip(used, map(float, model.coefficients), strict=True)], "feature string, coefficient double")


def fit_isotonic(rows: DataFrame) -> DataFrame:
    """The steps of an isotonic fit of label on p: boundary, value. Fitted on sums by p, not on rows."""
    from pyspark.ml.regression import IsotonicRegression

    sums = by_score(rows).select((F.col("good") / F.col("n")).alias("label"), "p", F.col("n").cast("double").alias("weight"))
    m = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(sums)
    return rows.sparkSession.createDataFrame(list(zip(map(float, m.boundaries), map(float, m.predictions), strict=True)), "boundary double, value double")
