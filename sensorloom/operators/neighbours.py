"""Inputs of the model-based fills: network average, neighbour slices, temporal features, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.fills import linear
from sensorloom.operators.grid import indexed
from sensorloom.operators.roadnet import top_neighbours


def network_average(traffic: DataFrame, rest: str = "filled") -> DataFrame:
    """``ts, value`` without gaps: mean over sensors, lines between, and the overall mean for what is left.

    ``rest``: whether that mean is of the filled series or of the observed one.
    """
    raw = traffic.groupBy("ts").agg(F.avg("value").alias("value"))  # a row for each hour: its window below is small
    filled = linear()(raw.withColumn("sensor_id", F.lit("all"))).select("ts", "value")
    mean = (filled if rest == "filled" else raw).agg(F.avg("value")).scalar()
    return filled.withColumn("value", F.coalesce("value", mean))


def neighbour_slices(traffic: DataFrame, adjacency: DataFrame, average: DataFrame, n: int = 10) -> DataFrame:
    """``target, ts, features array<double>`` of each sensor with a NULL: itself, its neighbours by rank, the network average.

    Neighbours that the table lacks are left out after the cut at ``n``. Neighbour values are NaN where missing.
    """
    gaps = traffic.groupBy("sensor_id").agg(F.count_if(F.col("value").isNull()).alias("nulls")).where("nulls > 0").select(F.col("sensor_id").alias("target"))
    own = gaps.select("target", F.col("target").alias("sensor_id"), F.lit(0).alias("rank"))
    near = top_neighbours(adjacency, n).join(gaps, "target", "left_semi").select("target", F.col("neighbour").alias("sensor_id"), "rank")
    cells = own.union(near).join(traffic.select("sensor_id", "ts", "value"), "sensor_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("value", F.lit(float("nan"))).alias("v")))), lambda s: s["v"])
    slices = cells.groupBy("target", "ts").agg(ordered.alias("features"))
    return slices.join(average.select("ts", F.col("value").alias("_average")), "ts").select("target", "ts", F.array_append("features", F.col("_average")).alias("features"))


def temporal_features(traffic: DataFrame, average: DataFrame) -> DataFrame:
    """``sensor_id, ts, value`` with the network average and its two lags, sine and cosine of hour and weekday, and three own lags; a lag before the start is the current value."""
    order = Window.orderBy("ts")  # over a row for each hour
    series = average.select("ts", F.col("value").alias("avg0"), F.coalesce(F.lag("value", 1).over(order), "value").alias("avg1"), F.coalesce(F.lag("value", 2).over(order), "value").alias("avg2"))
    own = Window.partitionBy("sensor_id").orderBy("ts")
    rows = traffic.select("sensor_id", "ts", "value", F.row_number().over(own).alias("_n"), *[F.lag("value", k).over(own).alias(f"_lag{k}") for k in (1, 2, 3)])
    turn = 6.283185307179586
    hour, day = F.hour("ts") * (turn / 24), F.weekday("ts") * (turn / 7)
    lags = [F.when(F.col("_n") <= k, F.col("value")).otherwise(F.col(f"_lag{k}")).alias(f"lag{k}") for k in (1, 2, 3)]
    return rows.join(series, "ts").select("sensor_id", "ts", "value", "avg0", "avg1", "avg2", F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos"), F.sin(day).alias("day_sin"), F.cos(day).alias("day_cos"), *lags)


def standardized_segments(traffic: DataFrame, length: int = 24) -> tuple[DataFrame, DataFrame]:
    """``segment, sensor_id, steps array<double>`` of z-scaled hours in whole segments, and the cells of the tail.

    Scaling is by sensor with the population deviation, 1 where that is 0. Fewer hours than a segment is an error.
    """
    group = Window.partitionBy("sensor_id")
    rows = indexed(traffic)
    hours = rows.agg(F.max("t_idx") + 1).first()[0] or 0
    if hours < length:
        raise ValueError(f"{hours} hours are fewer than a segment of {length}")
    spread = F.stddev_pop("value").over(group)
    rows = rows.withColumn("z", (F.col("value") - F.avg("value").over(group)) / F.when(spread > 0, spread).otherwise(1.0))
    whole = hours // length * length
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col("t_idx"), F.col("z")))), lambda s: s["z"])
    segments = rows.where(F.col("t_idx") < whole).groupBy(F.floor(F.col("t_idx") / length).alias("segment"), "sensor_id").agg(steps.alias("steps"))
    return segments, rows.where(F.col("t_idx") >= whole).select("sensor_id", "ts", "value")


def unscaled(segments: DataFrame, traffic: DataFrame, length: int = 24) -> DataFrame:
    """The inverse: ``sensor_id, ts, imputed`` of standardized segments."""
    stats = traffic.groupBy("sensor_id").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_spread"))
    cells = segments.select("sensor_id", "segment", F.posexplode("steps").alias("step", "z")).withColumn("t_idx", F.col("segment") * length + F.col("step"))
    start = traffic.agg(F.min("ts")).scalar()
    ts = start + F.make_dt_interval(F.lit(0), F.col("t_idx").cast("int"))
    return cells.join(stats, "sensor_id").select("sensor_id", ts.alias("ts"), (F.col("z") * F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(1.0) + F.col("_mean")).alias("imputed"))
