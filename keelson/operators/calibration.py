"""How well forecasts hold: Brier scores, curves, settlement divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import scoring as S


def clamped(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def brier_by(forecasts: DataFrame, *by: str) -> DataFrame:
    score = F.avg(S.brier(F.col("probability"), F.col("outcome")))
    return forecasts.where("resolved").groupBy(*by).agg(F.count("*").alias("n"), F.round(score, 6).alias("brier"), S.assess(score).alias("band"))


def curve(forecasts: DataFrame) -> DataFrame:
    """Tenths of probability with their observed share; over all, the mean of how far each
    tenth's middle is above its share, and what that says."""
    rows = forecasts.where("resolved").withColumn("p", clamped(F.col("probability")))
    bucket = F.least(F.lit(9).cast("long"), F.floor(F.col("p") * 10))
    by = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("outcome").cast("long").alias("hits")).withColumn("midpoint", (F.col("bucket") + 0.5) / 10)
    raw = F.try_divide(F.sum(F.col("midpoint") * F.col("n") - F.col("hits")), F.sum("n"))
    error = by.agg(F.round(raw, 6).alias("signed_error"), verdict(raw).alias("verdict"))
    return by.crossJoin(F.broadcast(error)).select("bucket", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("observed"), "midpoint", "signed_error", "verdict")


def verdict(signed_error: Column) -> Column:
    """By whole points of error, five of them either way being well calibrated."""
    points = F.floor(signed_error * 100 + 0.5)
    return F.when(points > 5, "overconfident").when(points < -5, "underconfident").otherwise("calibrated")


def by_category(forecasts: DataFrame) -> DataFrame:
    score = F.when(F.col("resolved"), S.brier(F.col("probability"), F.col("outcome")))
    return forecasts.rollup("category").agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), F.round(F.avg(score), 6).alias("brier"))


def divergence_rate(comparisons: DataFrame) -> DataFrame:
    known = comparisons.where("outcome is not null")
    bad = F.count_if(F.col("outcome") == "diverged")
    return known.agg(F.count("*").alias("resolved"), bad.alias("diverged"), F.round(F.coalesce(F.try_divide(bad, F.count("*")), F.lit(0.0)), 6).alias("rate"))
