"""The hourly grid: long traffic tables ``sensor_id, ts, value`` with NULL for missing, their masks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS = [f"hour{h:02d}" for h in range(24)]


def missing_as_null(value: Column) -> Column:
    """NaN becomes NULL, once, where tables come in."""
    return F.when(~F.isnan(value), value)


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from one hour to another, without any time zone."""
    return F.datediff(end, start) * 24 + F.hour(end) - F.hour(start)


def from_hour_columns(raw: DataFrame) -> DataFrame:
    """Raw counts ``statDate, linkID, hour00..hour23, seq`` as a long table; of a repeated hour the greatest seq wins, even if NULL."""
    long = raw.unpivot(["seq", "statDate", "linkID"], HOURS, "hour", "value")
    ts = F.col("statDate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.substring("hour", 5, 2).cast("int"))
    return long.groupBy(F.col("linkID").alias("sensor_id"), ts.alias("ts")).agg(F.max_by(missing_as_null(F.col("value").cast("double")), "seq").alias("value"))


def drop_never_observed(traffic: DataFrame) -> DataFrame:
    """Sensors with at least one value."""
    seen = traffic.groupBy("sensor_id").agg(F.count("value").alias("n")).where("n > 0")
    return traffic.join(seen, "sensor_id", "left_semi")


def cast_values(traffic: DataFrame, dtype: str) -> DataFrame:
    """Values as ``dtype``; integers are rounded half to even first."""
    value = F.bround("value", 0) if dtype in ("int", "long", "short", "byte", "bigint") else F.col("value")
    return traffic.withColumn("value", value.cast(dtype))


def step_hours(traffic: DataFrame) -> int:
    """The one gap between neighbouring times of the table; several gaps are an error."""
    times = traffic.select("ts").distinct()  # as many rows as hours
    gaps = times.select(hours_between(F.lag("ts").over(Window.orderBy("ts")), F.col("ts")).alias("gap")).where("gap is not null").distinct().limit(2).collect()
    if len(gaps) != 1:
        raise ValueError("the table's times have no single frequency")
    return gaps[0]["gap"]


def regular_grid(traffic: DataFrame, step: int = 1) -> DataFrame:
    """Every ``step`` hours between the table's first and last time, for every sensor; off-grid rows go, absent hours are NULL.

    Each row brings the absent hours up to the sensor's next one, its first row also those before. So the table is shuffled once, by sensor, and
    what follows by sensor needs no other shuffle.
    """
    bounds = traffic.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    jump, since = F.make_dt_interval(F.lit(0), F.lit(step)), hours_between(lo, F.col("ts"))
    on_grid = (F.pmod(since, F.lit(step)) == 0) & (lo + F.make_dt_interval(F.lit(0), since.cast("int")) == F.col("ts"))
    sensor = Window.partitionBy("sensor_id")
    series = sensor.orderBy(F.col("_at").asc_nulls_first())
    rows = traffic.withColumn("_at", F.when(on_grid, F.col("ts")))
    rows = rows.withColumns({"_before": F.lag("_at").over(series), "_next": F.lead("_at").over(series), "_n": F.row_number().over(series)}).withColumn("_last", F.max("_at").over(sensor))
    none = F.array().cast("array<timestamp_ntz>")
    hours = lambda a, b: F.when(a <= b, F.sequence(a, b, jump)).otherwise(none)
    at = F.col("_at")
    lead_in = F.when(F.col("_before").isNull(), hours(lo, at - jump)).otherwise(none)
    whole = F.concat(lead_in, F.array(at), hours(at + jump, F.coalesce(F.col("_next") - jump, hi)))
    # A sensor that only has off-grid rows gets all hours from its first row.
    spread = F.when(at.isNotNull(), whole).when((F.col("_n") == 1) & F.col("_last").isNull(), hours(lo, hi)).otherwise(none)
    cells = rows.withColumn("_ts", F.explode(spread))
    kept = [F.when(F.col("_ts") == at, F.col(c)).alias(c) for c in traffic.columns if c not in ("sensor_id", "ts")]
    return cells.select("sensor_id", F.col("_ts").alias("ts"), *kept)


def indexed(traffic: DataFrame) -> DataFrame:
    """Adds ``t_idx``, hours since the table's first time."""
    return traffic.withColumn("t_idx", hours_between(traffic.agg(F.min("ts")).scalar(), F.col("ts")))


def check_order(traffic: DataFrame) -> DataFrame:
    """The table itself, or an error if a sensor has an hour twice."""
    if not traffic.groupBy("sensor_id", "ts").count().where("count > 1").isEmpty():
        raise ValueError("a sensor has several rows of one time")
    return traffic


def select_sensors(traffic: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the requested sensors with their place ``idx``, and the requested ids that the table doesn't have."""
    known = traffic.select("sensor_id").distinct()
    return traffic.join(ids.select("idx", "sensor_id"), "sensor_id"), ids.join(known, "sensor_id", "left_anti")


def keep_sensors(traffic: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the sensors in ``ids``; unknown ids are ignored."""
    return traffic.join(ids.select("sensor_id"), "sensor_id", "left_semi")


def match_links(traffic: DataFrame, links: DataFrame) -> DataFrame:
    """Traffic on links of the region, with ``is_missing``."""
    return with_mask(keep_sensors(traffic, links.select(F.col("LINK_ID").alias("sensor_id"))))


def time_range(traffic: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive; None leaves an end open."""
    ts = F.col("ts")
    for bound, keep in ((start, ts.__ge__), (end, ts.__le__)):
        if bound is not None:
            traffic = traffic.where(keep(F.lit(bound).cast("timestamp_ntz")))
    return traffic


def missing_rates(traffic: DataFrame) -> DataFrame:
    """``sensor_id, missing_rate`` over the rows of the current frame."""
    return traffic.groupBy("sensor_id").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))


def filter_missing_rate(traffic: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Sensors whose missing rate is below the threshold; at 1 or more all stay."""
    if threshold >= 1:
        return traffic
    rate = F.avg(F.col("value").isNull().cast("double")).over(Window.partitionBy("sensor_id"))
    return traffic.withColumn("_rate", rate).where(F.col("_rate") < threshold).drop("_rate")


def split_at(traffic: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Before and from a time on, each on the grid of its own bounds."""
    cut = F.lit(at).cast("timestamp_ntz")
    return regular_grid(traffic.where(F.col("ts") < cut)), regular_grid(traffic.where(F.col("ts") >= cut))


def train_test(table: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    """Up to and from the cut, both inclusive: a row exactly at it is in both."""
    return time_range(table, end=cut), time_range(table, start=cut)


def with_mask(traffic: DataFrame) -> DataFrame:
    """Adds ``is_missing``."""
    return traffic.withColumn("is_missing", F.col("value").isNull())


def align_mask(traffic: DataFrame, mask: DataFrame) -> DataFrame:
    """Each cell's ``is_missing``; cells that the mask lacks are false."""
    joined = traffic.drop("is_missing").join(mask.select("sensor_id", "ts", "is_missing"), ["sensor_id", "ts"], "left")
    return joined.withColumn("is_missing", F.coalesce("is_missing", F.lit(False)))


def require_sensors(ids: DataFrame, traffic: DataFrame) -> None:
    """An error if a sensor of ``ids`` has no rows."""
    absent = ids.join(traffic.select("sensor_id").distinct(), "sensor_id", "left_anti").limit(5).collect()
    if absent:
        raise ValueError(f"sensors without data: {', '.join(r['sensor_id'] for r in absent)}")


def graph_order(traffic: DataFrame, sensors: DataFrame) -> DataFrame:
    """Rows of the graph's sensors with their matrix index; a sensor without rows is an error."""
    require_sensors(sensors, traffic)
    return traffic.join(sensors.select("sensor_id", F.col("idx").alias("node_idx")), "sensor_id")


def train_validation(traffic: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the time steps, and the others."""
    rows = indexed(traffic)
    steps = rows.agg(F.floor((F.max("t_idx") + 1) * F.lit(share))).scalar()
    return rows.where(F.col("t_idx") < steps), rows.where(F.col("t_idx") >= steps)


def restrict_to(table: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the target sensors; an unknown one is an error."""
    require_sensors(targets, table)
    return keep_sensors(table, targets)
