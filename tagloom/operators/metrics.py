"""Measures: nearest-rank percentiles, and thresholds from labelled similarity samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.components import materialised
from tagloom.operators.ordering import running

SAMPLES = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("ssim", T.DoubleType()), T.StructField("orb", T.DoubleType()), T.StructField("cosine", T.DoubleType())])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SAMPLES)


def nearest_rank(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """mean and exact nearest-rank percentiles p50, p95, ... of a column: the value at place ceil(share * n).

    Values are counted first, so that a place is found among distinct values.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    run = running(counts, [F.col("__v")], {"__to": F.col("__c")}, by)
    every = counts.groupBy(*(F.col(c).alias(f"__n_{c}") for c in by)).agg(F.sum("__c").alias("__n"))
    run = run.join(every, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__n_{c}")), by, F.lit(True)))
    place = [F.min(F.when(F.col("__to") >= F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("__n"))), F.col("__v"))).alias(f"p{round(s * 100)}") for s in shares]
    mean = (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("mean")
    return run.groupBy(*by).agg(mean, *place) if by else run.agg(mean, *place)


def _curve(samples: DataFrame, score: str) -> DataFrame:
    """By falling distinct score: positives and negatives at or above it, and their totals."""
    counts = samples.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("at")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    every = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return materialised(running(counts, [F.desc("at")], {"tp": F.col("pos"), "fp": F.col("neg")}).join(every), "curve")


def calibrate(samples: DataFrame, score: str) -> DataFrame:
    """threshold (greatest tpr - fpr, the highest score among equals), auc, average_precision of a score.

    The curve is over distinct scores, range-partitioned.
    """
    c = _curve(samples, score)
    tpr, fpr = F.col("tp") / F.col("all_pos"), F.col("fp") / F.col("all_neg")
    best = c.agg(F.max_by("at", F.struct(tpr - fpr, F.col("at"))).alias("threshold"))
    area = c.agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.first(F.col("all_pos") * F.col("all_neg"))).alias("auc"),
        F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"),
    )
    return best.crossJoin(area)
