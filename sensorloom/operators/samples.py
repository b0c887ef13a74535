"""Forecasting samples: windows of one sensor or of the whole network, calendar features, cubes and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.grid import graph_order, indexed


def _order() -> Window:
    return Window.partitionBy("sensor_id").orderBy("ts")


def _require(found: DataFrame, what: str) -> None:
    if found.isEmpty():
        raise ValueError(what)


def sensor_windows(masked: DataFrame, length: int = 24, allow_null: bool = False) -> DataFrame:
    """``sensor_id, ts, x, y, y_missing``: ``length`` values from ``ts`` on and the next one, if none is NULL. Input is a regular grid with ``is_missing``."""
    span = _order().rowsBetween(0, length)
    rows = masked.select(
        "sensor_id",
        "ts",
        F.count(F.lit(1)).over(span).alias("_rows"),
        F.count("value").over(span).alias("_n"),
        F.transform(F.collect_list(F.struct("value")).over(_order().rowsBetween(0, length - 1)), lambda s: s["value"]).alias("x"),
        F.lead("value", length).over(_order()).alias("y"),
        F.lead("is_missing", length).over(_order()).alias("y_missing"),
    )
    kept = rows.where(F.col("_rows") == length + 1)
    _require(kept.limit(1), f"no series is longer than {length}")
    return (kept if allow_null else kept.where(F.col("_n") == length + 1)).drop("_rows", "_n")


def valid_starts(masked: DataFrame, offsets: list[int], span: int) -> DataFrame:
    """``start``: time steps from which no sensor has a NULL at any of ``offsets``; ``span`` steps must exist."""
    rows = indexed(masked)
    steps = rows.groupBy("t_idx").agg(F.count_if(F.col("value").isNull()).alias("nulls"))  # a row for each hour
    last = steps.agg(F.max("t_idx")).scalar()
    uses = steps.select("t_idx", "nulls", F.explode(F.array(*map(F.lit, offsets))).alias("k")).withColumn("start", F.col("t_idx") - F.col("k"))
    return uses.where((F.col("start") >= 0) & (F.col("start") + span - 1 <= last)).groupBy("start").agg(F.sum("nulls").alias("nulls"), F.count(F.lit(1)).alias("n")).where((F.col("nulls") == 0) & (F.col("n") == len(offsets))).select("start")


def _windows(masked: DataFrame, starts: DataFrame | None, n_in: int, outputs: list[int], span: int) -> DataFrame:
    """``start, sensor_id, x, y, y_missing`` of a regular grid, kept where all of ``span`` steps exist; ``outputs`` are steps one after the other.

    A sensor's series becomes arrays of some days each, which overlap by ``span - 1`` steps; windows are slices of them. The table is shuffled once, by sensor,
    or not at all if it comes so; ``starts`` has a row for each hour at most.
    """
    size = max(168, 4 * span)
    rows = indexed(masked).withColumn("t_idx", F.col("t_idx").cast("long"))
    ends = masked.agg(F.max("ts").alias("hi"), F.min("ts").alias("lo"))
    last = ends.select((F.datediff("hi", "lo") * 24 + F.hour("hi") - F.hour("lo") - span + 1).cast("long")).scalar()
    of = lambda t: F.floor(t / size)
    pieces = F.sequence(F.greatest(of(F.col("t_idx") - span + 1), F.lit(0).cast("long")), of(F.col("t_idx")))
    cells = rows.select("sensor_id", F.explode(pieces).alias("piece"), F.struct(F.col("t_idx").alias("at"), "value", "is_missing").alias("cell"))
    series = cells.groupBy("sensor_id", "piece").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    series = series.select("sensor_id", (F.col("piece") * size).alias("first"), "cells.at", "cells.value", "cells.is_missing")
    found = series.select("*", F.posexplode("at").alias("p", "start")).where((F.col("start") < F.col("first") + size) & (F.col("start") <= last))
    found = found.where(F.get("at", F.col("p") + span - 1) == F.col("start") + span - 1)  # all steps are there
    if starts is not None:
        found = found.join(F.broadcast(starts), "start", "left_semi")
    later = lambda c: F.slice(c, F.col("p") + 1 + outputs[0], len(outputs))
    return found.select("start", "sensor_id", F.slice("value", F.col("p") + 1, n_in).alias("x"), later("value").alias("y"), later("is_missing").alias("y_missing"))


def network_windows(masked: DataFrame, in_steps: int = 24, out_steps: int = 1) -> DataFrame:
    """Windows of all sensors over ``in_steps`` and the ``out_steps`` after; none valid is an error."""
    span = in_steps + out_steps
    starts = valid_starts(masked, list(range(span)), span)
    _require(starts.limit(1), "no window without missing values")
    return _windows(masked, starts, in_steps, list(range(in_steps, span)), span)


def single_step_windows(masked: DataFrame, n_his: int = 24, n_pred: int = 1) -> DataFrame:
    """As ``network_windows``, but only the last of ``n_pred`` steps is the target, and NULLs between don't matter."""
    span = n_his + n_pred
    starts = valid_starts(masked, [*range(n_his), span - 1], span)
    return _windows(masked, starts, n_his, [span - 1], span)


def retention(masked: DataFrame, n_his: int = 24, n_pred: int = 1) -> DataFrame:
    """``n_windows, n_valid, percent`` of ``single_step_windows``."""
    span = n_his + n_pred
    starts = valid_starts(masked, [*range(n_his), span - 1], span)
    total = F.greatest(indexed(masked).agg(F.max("t_idx")).scalar() + 2 - span, F.lit(0))
    return starts.agg(F.count(F.lit(1)).alias("n_valid")).select(total.cast("long").alias("n_windows"), "n_valid", (F.try_divide(F.col("n_valid") * 100.0, total.cast("double"))).alias("percent"))


def all_windows(masked: DataFrame, seq_len: int = 24, horizon: int = 1) -> DataFrame:
    """Every window, NULLs and all."""
    span = seq_len + horizon
    return _windows(masked, None, seq_len, list(range(seq_len, span)), span)


def time_of_day(ts: str = "ts") -> Column:
    """Fraction of the day, from 0 to below 1."""
    return (F.hour(ts) * 60 + F.minute(ts)) / 1440


def day_of_week(ts: str = "ts", one_hot: bool = False) -> Column:
    """Monday is 0; or seven numbers of which one is 1."""
    day = F.weekday(ts)
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: (k == day).cast("double")) if one_hot else day


def feature_cube(traffic: DataFrame, sensors: DataFrame, include_tod: bool = True, include_dow: bool = True) -> DataFrame:
    """``t_idx, ts, node_idx, sensor_id, features array<float>`` in the graph's order; a sensor without data is an error."""
    rows = indexed(graph_order(traffic, sensors))
    parts = [F.col("value"), *([time_of_day()] if include_tod else []), *([day_of_week()] if include_dow else [])]
    return rows.select("t_idx", "ts", "node_idx", "sensor_id", F.array(*[p.cast("float") for p in parts]).alias("features"))


def check_cube(cube: DataFrame, sensors: DataFrame) -> DataFrame:
    """``cube_sensors, graph_sensors, compatible``."""
    graph = sensors.agg(F.count_distinct("sensor_id")).scalar()
    return cube.agg(F.count_distinct("sensor_id").alias("cube_sensors")).select("cube_sensors", graph.alias("graph_sensors"), (F.col("cube_sensors") == graph).alias("compatible"))


def fit_scaler(train: DataFrame, method: str = "normal", length: int = 24) -> DataFrame:
    """One row ``lo, hi``: bounds of all cells (normal), of cells inside a valid window of a sensor (strict), or 0 and 1 (none)."""
    if method == "none":
        return train.sparkSession.range(1).select(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    rows = train
    if method == "strict":
        # The window begun at a row is whole; a cell counts if one of the rows up to ``length`` before begins such.
        whole = F.count("value").over(_order().rowsBetween(0, length)) == length + 1
        rows = train.withColumn("_whole", whole).withColumn("_used", F.max("_whole").over(_order().rowsBetween(-length, 0))).where("_used")
    found = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = found.first()
    if lo is None:
        raise ValueError("no values to scale by")
    return train.sparkSession.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


def scale(traffic: DataFrame, scaler: DataFrame, inverse: bool = False) -> DataFrame:
    """(value - lo) / (hi - lo), or back; a range of 0 divides by 1, NULL stays."""
    lo, hi = scaler.select("lo").scalar(), scaler.select("hi").scalar()
    width = F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return traffic.withColumn("value", F.col("value") * width + lo if inverse else (F.col("value") - lo) / width)
