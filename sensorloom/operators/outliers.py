"""Outliers become NULL. Each step is a function of its settings that returns ``DataFrame -> DataFrame``; steps chain in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]

#: Far above what sums of doubles lose by rounding, far below the least step between whole counts.
_ROUNDING = 1e-12


def _sensor() -> Window:
    return Window.partitionBy("sensor_id")


def chain(traffic: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Applies steps in order; user-defined ones are functions of the same shape."""
    for step in steps:
        traffic = step(traffic)
    return traffic


def _keep(traffic: DataFrame, condition: Column) -> DataFrame:
    """Values for which the condition is true; a NULL condition drops the value."""
    return traffic.withColumn("value", F.when(condition, F.col("value")))


def _far(mean: Column, spread: Column, limit: float) -> Column:
    """Whether a value lies further from the mean than ``limit`` spreads; never without a positive spread.

    A value exactly at the limit stays, whatever the order of the sums: less than ``_ROUNDING`` of what is compared doesn't count.
    """
    off, bound = F.abs(F.col("value") - mean), limit * spread
    return F.coalesce((spread > 0) & (off - bound > _ROUNDING * (F.abs("value") + F.abs(mean) + bound)), F.lit(False))


def absolute_limit(threshold: float = 8000) -> Step:
    return lambda t: _keep(t, F.abs("value") <= threshold)


def zeros_beside_gaps() -> Step:
    """In a run of zeros and NULLs that holds a NULL, the zeros become NULL; other runs of zeros stay."""

    def step(traffic: DataFrame) -> DataFrame:
        upto = Window.partitionBy("sensor_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        rows = traffic.withColumn("_run", F.count(F.when(F.col("value") != 0, 1)).over(upto))
        gap = F.max(F.col("value").isNull()).over(Window.partitionBy("sensor_id", "_run"))
        return _keep(rows.withColumn("_gap", gap), ~((F.col("value") == 0) & F.col("_gap"))).drop("_run", "_gap")

    return step


def road_capacity(metadata: DataFrame) -> Step:
    """Values over lanes times the hourly capacity of a lane at the road's speed limit."""

    def step(traffic: DataFrame) -> DataFrame:
        roads = metadata.select(F.col("LINK_ID").alias("sensor_id"), (F.col("LANES") * F.when(F.col("MAX_SPD") <= 80, 3000).when(F.col("MAX_SPD") <= 100, 3300).otherwise(3450)).alias("_capacity"))
        unknown = traffic.select("sensor_id").distinct().join(roads, "sensor_id", "left_anti").limit(5).collect()
        if unknown:
            raise KeyError(f"no metadata of {', '.join(r['sensor_id'] for r in unknown)}")
        return _keep(traffic.join(roads, "sensor_id"), F.col("value") <= F.col("_capacity")).drop("_capacity")

    return step


def _grouped_z(limit: float, spread: Callable[[str], Column], *keys: Column | str) -> Step:
    def step(traffic: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        rows = traffic.withColumn("_mean", F.avg("value").over(group)).withColumn("_spread", spread("value").over(group))
        return _keep(rows, ~_far(F.col("_mean"), F.col("_spread"), limit)).drop("_mean", "_spread")

    return step


def hourly_z(limit: float = 3.0) -> Step:
    """By sensor and hour of day, with the sample deviation."""
    return lambda t: _grouped_z(limit, F.stddev_samp, "sensor_id", F.hour("ts"))(t)


def monthly_hourly_z(limit: float = 3.0) -> Step:
    """By sensor, month of year and hour of day."""
    return lambda t: _grouped_z(limit, F.stddev_samp, "sensor_id", F.month("ts"), F.hour("ts"))(t)


def sensor_z(limit: float = 3.0) -> Step:
    """By sensor, with the population deviation."""
    return lambda t: _grouped_z(limit, F.stddev_pop, "sensor_id")(t)


def network_hourly_z(limit: float = 3.0) -> Step:
    """By hour of day over all sensors; all 24 hours need a positive deviation."""

    def step(traffic: DataFrame) -> DataFrame:
        hours = traffic.groupBy(F.hour("ts").alias("_hour")).agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_spread"))
        if hours.where("_spread > 0").count() < 24:
            raise ValueError("an hour of the day has no positive deviation")
        rows = traffic.withColumn("_hour", F.hour("ts")).join(F.broadcast(hours), "_hour")  # 24 rows
        return _keep(rows, ~_far(F.col("_mean"), F.col("_spread"), limit)).drop("_hour", "_mean", "_spread")

    return step


def median_deviation(limit: float = 3.5, least: float = 1e-9) -> Step:
    """By sensor, scaled distance from the median in median absolute deviations."""

    def step(traffic: DataFrame) -> DataFrame:
        rows = traffic.withColumn("_off", F.abs(F.col("value") - F.median("value").over(_sensor())))
        return _keep(rows.withColumn("_mad", F.median("_off").over(_sensor())), 0.6745 * F.col("_off") / (F.col("_mad") + least) <= limit).drop("_off", "_mad")

    return step


def trimmed_z(rate: float = 0.05, limit: float = 3.0, least: float = 1e-9) -> Step:
    """By sensor, against mean and deviation of the middle values. Where ``rate`` trims nothing (few values) no statistic is
    defined and the sensor becomes NULL; where it would trim all, the sensor stays."""

    def step(traffic: DataFrame) -> DataFrame:
        n = F.count("value").over(_sensor())
        rank = F.row_number().over(_sensor().orderBy(F.col("value").asc_nulls_last(), "ts"))
        rows = traffic.withColumn("_n", n).withColumn("_cut", F.floor(F.col("_n") * F.lit(rate))).withColumn("_rank", rank)
        middle = F.when((F.col("_cut") > 0) & (F.col("_rank") > F.col("_cut")) & (F.col("_rank") <= F.col("_n") - F.col("_cut")), F.col("value"))
        rows = rows.withColumn("_mid", middle).withColumn("_mean", F.avg("_mid").over(_sensor())).withColumn("_spread", F.stddev_samp("_mid").over(_sensor()))
        kept = F.abs(F.col("value") - F.col("_mean")) / (F.col("_spread") + least) <= limit
        return _keep(rows, F.when(F.col("_cut") * 2 >= F.col("_n"), F.col("_cut") > 0).otherwise(kept)).drop("_n", "_cut", "_rank", "_mid", "_mean", "_spread")

    return step


def global_z(limit: float = 3.0) -> Step:
    """Over all cells, with the population deviation."""

    def step(traffic: DataFrame) -> DataFrame:
        stats = traffic.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
        return _keep(traffic, ~_far(stats.select("mean").scalar(), stats.select("spread").scalar(), limit))

    return step


def winsorized_z(rate: float = 0.05, limit: float = 3.0) -> Step:
    """By sensor: the extreme ``rate`` of cells at either end take the next value (NULLs sort last), then a z test."""

    def step(traffic: DataFrame) -> DataFrame:
        rank = F.row_number().over(_sensor().orderBy(F.col("value").asc_nulls_last(), "ts"))
        rows = traffic.withColumn("_n", F.count(F.lit(1)).over(_sensor())).withColumn("_k", F.floor(F.lit(rate) * F.col("_n"))).withColumn("_rank", rank)
        low = F.max(F.when(F.col("_rank") == F.col("_k") + 1, F.col("value"))).over(_sensor())
        high = F.max(F.when(F.col("_rank") == F.col("_n") - F.col("_k"), F.col("value"))).over(_sensor())
        rows = rows.withColumn("_low", low).withColumn("_high", high)
        value = F.when(F.col("_rank") > F.col("_n") - F.col("_k"), F.col("_high")).when(F.col("_rank") <= F.col("_k"), F.col("_low")).otherwise(F.col("value"))
        rows = rows.withColumn("value", value).drop("_n", "_k", "_rank", "_low", "_high")
        return _grouped_z(limit, F.stddev_samp, "sensor_id")(rows)

    return step


def step_status(traffic: DataFrame, *keys: Column) -> DataFrame:
    """``sensor_id, n_groups, n_valid, ok``: whether each sensor has a usable deviation in the groups of ``keys``."""
    groups = traffic.groupBy("sensor_id", *keys).agg(F.stddev_samp("value").alias("spread"))
    return groups.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("spread") > 0).alias("n_valid"), (F.count_if(F.col("spread") > 0) > 0).alias("ok"))
