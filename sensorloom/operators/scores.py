"""Scores of predictions ``sensor_id, ts, horizon, y_true, y_pred, is_missing``, as plain aggregates."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def mae() -> Column:
    return F.avg(F.abs(F.col("y_true") - F.col("y_pred")))


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2))))


def smape() -> Column:
    """In percent; pairs of zeros don't count, and none left gives 0."""
    half = (F.abs("y_true") + F.abs("y_pred")) / 2
    return F.coalesce(F.avg(F.when(half != 0, F.abs(F.col("y_true") - F.col("y_pred")) / half)) * 100, F.lit(0.0))


def wmape() -> Column:
    return F.try_divide(F.sum(F.abs(F.col("y_true") - F.col("y_pred"))), F.sum("y_true"))


def score(predictions: DataFrame, *keys: str) -> DataFrame:
    """MAE, RMSE, sMAPE and WMAPE, of all rows or for each group."""
    return predictions.groupBy(*keys).agg(mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape"), wmape().alias("wmape"))


def observed_only(predictions: DataFrame) -> DataFrame:
    """Scores on cells that weren't imputed; no row, and a warning, if there is none."""
    seen = predictions.where(~F.col("is_missing"))
    if seen.isEmpty():
        warnings.warn("no observed cell to score", stacklevel=2)
        return score(seen).where(F.lit(False))
    return score(seen)


def cell_shares(predictions: DataFrame) -> DataFrame:
    """``n_total, n_observed, n_imputed, observed_percent``."""
    return predictions.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~F.col("is_missing")).alias("n_observed"), F.count_if("is_missing").alias("n_imputed")).withColumn("observed_percent", F.try_divide(F.col("n_observed") * 100.0, F.col("n_total").cast("double")))


def at_horizons(predictions: DataFrame, horizons: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """``horizon, mae`` for those of ``horizons`` that exist."""
    return predictions.where(F.col("horizon").isin(*horizons)).groupBy("horizon").agg(mae().alias("mae"))
