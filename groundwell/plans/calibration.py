"""Queries over labelled documents as a calibration sample: p is a sigmoid of the text's length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import calibration as c
from groundwell.operators import models as m
from groundwell.sources.tables import read
from groundwell.sources.work import saved


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, p and features."""
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    x = F.log(F.col("n_chars") + 1.0) - 5.0
    return both.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic", F.round(1 / (1 + F.exp(-x)), 4).alias("p"), F.log(F.col("n_chars") + 1.0).alias("length"), (F.col("lang") == "en").cast("double").alias("english"))


def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.calibration_error(sample(spark, sf_dir))


def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.reliability(sample(spark, sf_dir))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.roc_auc(sample(spark, sf_dir))


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.risk_coverage(sample(spark, sf_dir))


def tau_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.best_threshold(sample(spark, sf_dir), 0.10)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.bootstrap(sample(spark, sf_dir))


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.fit_logistic(sample(spark, sf_dir), ["length", "english", "toxic"])


FEATURES = ["length", "english", "toxic"]


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about a fit: its sizes, the penalty that cross-validation chose, AUC, Brier score, calibration error, and what follows from them."""
    r = m.report(saved(sample(spark, sf_dir), "sample"), FEATURES)
    return spark.createDataFrame([tuple(r.values())], "n long, positives long, predictors int, degenerate boolean, c double, auc double, brier double, ece double, calibrate boolean, reliable boolean")


def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cross_validated(saved(sample(spark, sf_dir), "sample"), FEATURES)


def coefficient_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.intervals(saved(sample(spark, sf_dir), "sample"), FEATURES, 1.0)


def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.answer_errors(sample(spark, sf_dir), [0.40, 0.65])


_S = "s AS (SELECT doc_id AS id, quality AS label, round(1 / (1 + exp(-(ln(n_chars + 1.0) - 5.0))), 4) AS p FROM labels JOIN documents USING (doc_id))"
_R = f"{_S}, r AS (SELECT CAST(greatest(1, least(5, ceil(round(p * 5, 9)))) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(label AS DOUBLE)), 6) AS rate FROM s GROUP BY 1)"
_C = f"""{_S}, g AS (SELECT p, count(*) AS n, sum(label) AS good FROM s GROUP BY p), t AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS taken, sum(good) OVER (ORDER BY p DESC) AS ok, sum(n) OVER () AS total FROM g),
c AS (SELECT p, round(taken / total, 6) AS coverage, round((taken - ok) / taken, 6) AS risk, n FROM t)"""

QUERIES = {f.__name__: f for f in (ece_bins, reliability_curve, roc_auc, risk_coverage, tau_selection, bootstrap_ci, logistic_fit, model_report, cv_scores, coefficient_ci, answer_errors)}
ORACLE_SQL = {
    "answer_errors": f"WITH {_S} SELECT CAST(tau AS DOUBLE) AS tau, round(coalesce(count(*) FILTER (p >= tau AND label = 0) / nullif(count(*) FILTER (p >= tau), 0), 0.0), 6) AS false_answers, round(coalesce(count(*) FILTER (p < tau AND label = 1) / nullif(count(*) FILTER (label = 1), 0), 0.0), 6) AS false_abstentions, count(*) FILTER (p >= tau) AS answered FROM s, (SELECT unnest([0.40, 0.65]) AS tau) GROUP BY tau",
    "ece_bins": f"WITH {_R} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM r",
    "reliability_curve": f"WITH {_R} SELECT * FROM r",
    "roc_auc": f"WITH {_S}, k AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM k",
    "risk_coverage": f"WITH {_C} SELECT * FROM c",
    "tau_selection": f"WITH {_C} SELECT (SELECT p FROM c WHERE risk <= 0.1 ORDER BY coverage DESC, p DESC LIMIT 1) AS tau, (SELECT max(coverage) FROM c WHERE risk <= 0.1) AS coverage, (SELECT round(1 - risk, 6) FROM c WHERE coverage <= 0.8 ORDER BY coverage DESC, risk DESC LIMIT 1) AS accuracy_at_80, (SELECT round(sum(risk * n) / sum(n), 6) FROM c) AS aurc",
}
