"""Simple imputation: NULL cells of a regular grid take values. Steps chain like those of ``outliers``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.grid import hours_between
from sensorloom.operators.outliers import Step


def _neighbours(traffic: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """The table with the nearest values before and after, those values, and the line between them."""
    order = Window.partitionBy("sensor_id").orderBy("ts")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.struct(F.col("value").alias("v"), F.col("ts").alias("t"))
    seen = F.when(F.col("value").isNotNull(), at)
    rows = traffic.withColumn("_before", F.last(seen, ignorenulls=True).over(back)).withColumn("_after", F.first(seen, ignorenulls=True).over(ahead))
    before, after = F.col("_before.v"), F.col("_after.v")
    passed, whole = hours_between(F.col("_before.t"), F.col("ts")), hours_between(F.col("_before.t"), F.col("_after.t"))
    line = before + (after - before) * F.try_divide(passed.cast("double"), whole.cast("double"))
    return rows, before, after, line


def linear() -> Step:
    """Lines between neighbours; later NULLs take the last value, earlier ones stay."""

    def step(traffic: DataFrame) -> DataFrame:
        rows, before, _, line = _neighbours(traffic)
        return rows.withColumn("value", F.coalesce("value", line, before)).drop("_before", "_after")

    return step


def spline() -> Step:
    """Lines inside gaps only."""

    def step(traffic: DataFrame) -> DataFrame:
        rows, _, _, line = _neighbours(traffic)
        return rows.withColumn("value", F.coalesce("value", line)).drop("_before", "_after")

    return step


def hour_mean() -> Step:
    """The sensor's mean of the hour of day; then all values, also observed ones, are rounded half to even."""
    return lambda t: t.withColumn("value", F.bround(F.coalesce("value", F.avg("value").over(Window.partitionBy("sensor_id", F.hour("ts")))), 0))


def month_mean() -> Step:
    """The sensor's mean of the calendar month."""
    return lambda t: t.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("sensor_id", F.year("ts"), F.month("ts")))))


def shifted(periods: int = 168) -> Step:
    """The first original value found ``periods`` hours back, twice as far back, and so on."""

    def step(traffic: DataFrame) -> DataFrame:
        # Hours since any fixed time have the same phases, so the table's first time needn't be found.
        since = hours_between(F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
        phase = Window.partitionBy("sensor_id", F.pmod(since, F.lit(periods))).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
        return traffic.withColumn("value", F.coalesce("value", F.last("value", ignorenulls=True).over(phase)))

    return step


def holiday_mean(holidays: DataFrame) -> Step:
    """The sensor's mean of month, hour and free day (weekend or in ``holidays(date)``); what is left takes the mean of the hour of the filled series."""

    def step(traffic: DataFrame) -> DataFrame:
        days = holidays.select(F.col("date").alias("_date"), F.lit(True).alias("_listed")).distinct()
        rows = traffic.withColumn("_date", F.to_date("ts")).join(days, "_date", "left")
        rows = rows.withColumn("_free", F.coalesce("_listed", F.lit(False)) | (F.weekday("ts") >= 5))
        rows = rows.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("sensor_id", F.month("ts"), F.hour("ts"), "_free"))))
        rows = rows.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("sensor_id", F.hour("ts")))))
        return rows.drop("_date", "_listed", "_free")

    return step


def fallback(method: str = "linear") -> Step:
    """What a model left: linear (edges take the nearest value), ffill, bfill or median; then 0. Other names mean linear."""

    def step(traffic: DataFrame) -> DataFrame:
        if method == "median":
            return traffic.withColumn("value", F.coalesce("value", F.median("value").over(Window.partitionBy("sensor_id")), F.lit(0.0)))
        rows, before, after, line = _neighbours(traffic)
        order = {"ffill": (before, after), "bfill": (after, before)}.get(method, (line, before, after))
        return rows.withColumn("value", F.coalesce("value", *order, F.lit(0.0))).drop("_before", "_after")

    return step


def write_back(traffic: DataFrame, model: DataFrame) -> DataFrame:
    """Model output ``sensor_id, ts, imputed`` for NULL cells only."""
    joined = traffic.join(model.select("sensor_id", "ts", "imputed"), ["sensor_id", "ts"], "left")
    return joined.withColumn("value", F.coalesce("value", "imputed")).drop("imputed")
