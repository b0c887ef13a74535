"""Queries of the outlier steps and the simple fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import fills as L
from sensorloom.operators import outliers as O
from sensorloom.queries import inputs as I
from sensorloom.queries.catalog import query

_OUT = "select sensor_id, ts, round(value, 6) as value from out"


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("sensor_id", "ts", F.round("value", 6).alias("value"))


def _stepped(name: str, step, sql: str, doc: str) -> None:
    """A query that applies one step to the grid."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _out(step(spark, sf_dir)(I.grid(spark, sf_dir)))

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


def _z(keys: str, spread: str, limit: float) -> str:
    return f"""with {I.GRID}, s as (select *, avg(value) over w mean, {spread}(value) over w sd from grid window w as (partition by {keys})),
out as (select sensor_id, ts, case when sd > 0 and abs(value - mean) > {limit} * sd then null else value end as value from s) {_OUT}"""


_stepped("o1_absolute_limit", lambda s, d: O.absolute_limit(12), f"with {I.GRID}, out as (select sensor_id, ts, case when abs(value) <= 12 then value end as value from grid) {_OUT}", "Counts over a limit.")
_stepped(
    "o2_zeros_beside_gaps",
    lambda s, d: O.zeros_beside_gaps(),
    f"""with {I.GRID}, runs as (select *, count(case when value <> 0 then 1 end) over (partition by sensor_id order by ts rows unbounded preceding) run from grid),
out as (select sensor_id, ts, case when value = 0 and bool_or(value is null) over (partition by sensor_id, run) then null else value end as value from runs) {_OUT}""",
    "Zeros in a run that touches a gap.",
)
_stepped(
    "o3_road_capacity",
    lambda s, d: _scaled_capacity(s, d),
    f"""with {I.GRID}, {I.LINKS}, out as (
  select sensor_id, ts, case when value * 100 <= LANES * case when MAX_SPD <= 80 then 3000 when MAX_SPD <= 100 then 3300 else 3450 end then value * 100 end as value
  from grid join links on LINK_ID = sensor_id) {_OUT}""",
    "Counts, in hundreds, over the road's capacity.",
)


def _scaled_capacity(spark: SparkSession, sf_dir: str) -> O.Step:
    step = O.road_capacity(I.links(spark, sf_dir))
    return lambda t: step(t.withColumn("value", F.col("value") * 100))


_stepped("o4_hourly_z", lambda s, d: O.hourly_z(2.0), _z("sensor_id, hour(ts)", "stddev_samp", 2.0), "Z-score by sensor and hour.")
_stepped("o5_monthly_hourly_z", lambda s, d: O.monthly_hourly_z(2.0), _z("sensor_id, month(ts), hour(ts)", "stddev_samp", 2.0), "Z-score by sensor, month and hour.")
_stepped("o6_network_hourly_z", lambda s, d: O.network_hourly_z(2.5), _z("hour(ts)", "stddev_samp", 2.5), "Z-score by hour over all sensors.")
_stepped(
    "o7_median_deviation",
    lambda s, d: O.median_deviation(3.5),
    f"""with {I.GRID}, a as (select *, abs(value - median(value) over (partition by sensor_id)) off from grid),
b as (select *, median(off) over (partition by sensor_id) mad from a),
out as (select sensor_id, ts, case when 0.6745 * off / (mad + 1e-9) <= 3.5 then value end as value from b) {_OUT}""",
    "Median absolute deviation by sensor.",
)
_stepped(
    "o8_trimmed_z",
    lambda s, d: O.trimmed_z(),
    f"""with {I.GRID}, a as (select *, count(value) over (partition by sensor_id) n, row_number() over (partition by sensor_id order by value nulls last, ts) r from grid),
b as (select *, floor(n * 0.05::double) cut from a),
c as (select *, case when cut > 0 and r > cut and r <= n - cut then value end mid from b),
e as (select *, avg(mid) over (partition by sensor_id) mean, stddev_samp(mid) over (partition by sensor_id) sd from c),
out as (select sensor_id, ts, case when cut * 2 >= n then case when cut > 0 then value end when abs(value - mean) / (sd + 1e-9) <= 3 then value end as value from e) {_OUT}""",
    "Z-score against the trimmed mean.",
)
_stepped("o9_global_z", lambda s, d: O.global_z(2.5), f"with {I.GRID}, s as (select avg(value) mean, stddev_pop(value) sd from grid), out as (select sensor_id, ts, case when abs(value - mean) > 2.5 * sd then null else value end as value from grid, s) {_OUT}", "Z-score over all cells.")
_stepped("o10_sensor_z", lambda s, d: O.sensor_z(2.5), _z("sensor_id", "stddev_pop", 2.5), "Z-score by sensor.")
_stepped(
    "o11_winsorized_z",
    lambda s, d: O.winsorized_z(),
    f"""with {I.GRID}, a as (select *, count(*) over (partition by sensor_id) n, row_number() over (partition by sensor_id order by value nulls last, ts) r from grid),
b as (select *, floor(0.05::double * n) k from a),
c as (select *, max(case when r = k + 1 then value end) over (partition by sensor_id) low, max(case when r = n - k then value end) over (partition by sensor_id) high from b),
w as (select sensor_id, ts, case when r > n - k then high when r <= k then low else value end as value from c),
s as (select *, avg(value) over (partition by sensor_id) mean, stddev_samp(value) over (partition by sensor_id) sd from w),
out as (select sensor_id, ts, case when sd > 0 and abs(value - mean) > 3 * sd then null else value end as value from s) {_OUT}""",
    "Winsorized values, then a z-score by sensor.",
)


@query(f"""with {I.GRID}, g as (select sensor_id, hour(ts) h, stddev_samp(value) sd from grid group by 1, 2)
select sensor_id, count(*) n_groups, count(*) filter (sd > 0) n_valid, count(*) filter (sd > 0) > 0 ok from g group by 1""")
def o12_step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sensors have usable hourly deviations."""
    return O.step_status(I.grid(spark, sf_dir), F.hour("ts"))


_NEAR = f"""with {I.GRID}, a as (
  select *, last_value(value ignore nulls) over b bv, last_value(case when value is not null then t_idx end ignore nulls) over b bt,
         first_value(value ignore nulls) over f fv, first_value(case when value is not null then t_idx end ignore nulls) over f ft
  from grid window b as (partition by sensor_id order by ts rows between unbounded preceding and current row),
                   f as (partition by sensor_id order by ts rows between current row and unbounded following)),
l as (select *, bv + (fv - bv) * ((t_idx - bt)::double / nullif(ft - bt, 0)) line from a),"""

_stepped("i1_linear", lambda s, d: L.linear(), f"{_NEAR} out as (select sensor_id, ts, coalesce(value, line, bv) as value from l) {_OUT}", "Lines; the last value lasts.")
_stepped("i2_spline", lambda s, d: L.spline(), f"{_NEAR} out as (select sensor_id, ts, coalesce(value, line) as value from l) {_OUT}", "Lines inside gaps.")
_stepped("i3_hour_mean", lambda s, d: L.hour_mean(), f"with {I.GRID}, out as (select sensor_id, ts, round_even(coalesce(value, avg(value) over (partition by sensor_id, hour(ts))), 0) as value from grid) {_OUT}", "Hour-of-day means.")
_stepped("i4_shifted", lambda s, d: L.shifted(168), f"with {I.GRID}, out as (select sensor_id, ts, coalesce(value, last_value(value ignore nulls) over (partition by sensor_id, t_idx % 168 order by ts rows between unbounded preceding and 1 preceding)) as value from grid) {_OUT}", "The same hour of earlier weeks.")
_stepped("i5_month_mean", lambda s, d: L.month_mean(), f"with {I.GRID}, out as (select sensor_id, ts, coalesce(value, avg(value) over (partition by sensor_id, year(ts), month(ts))) as value from grid) {_OUT}", "Means of the month.")
_stepped(
    "i6_holiday_mean",
    lambda s, d: L.holiday_mean(I.holidays(s, d)),
    f"""with {I.GRID}, a as (select *, isodow(ts) >= 6 or cast(ts as date) in ({', '.join(f"date '{d}'" for d in I.HOLIDAYS)}) free from grid),
b as (select sensor_id, ts, coalesce(value, avg(value) over (partition by sensor_id, month(ts), hour(ts), free)) as value from a),
out as (select sensor_id, ts, coalesce(value, avg(value) over (partition by sensor_id, hour(ts))) as value from b) {_OUT}""",
    "Means of month, hour and kind of day.",
)
for _method, _order in {"linear": "value, line, bv, fv", "ffill": "value, bv, fv", "bfill": "value, fv, bv", "median": "value, median(value) over (partition by sensor_id)"}.items():
    _stepped(f"i7_fallback_{_method}", lambda s, d, m=_method: L.fallback(m), f"{_NEAR} out as (select sensor_id, ts, coalesce({_order}, 0) as value from l) {_OUT}", f"The {_method} fallback.")


@query(f"with {I.GRID}, out as (select sensor_id, ts, coalesce(value, t_idx / 10.0) as value from grid) {_OUT}")
def i8_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output for missing cells only."""
    from sensorloom.operators.grid import indexed

    rows = I.grid(spark, sf_dir)
    return _out(L.write_back(rows, indexed(rows).select("sensor_id", "ts", (F.col("t_idx") / 10).alias("imputed"))))
