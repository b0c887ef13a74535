"""Queries of samples, scaling and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import grid as G
from sensorloom.operators import samples as S
from sensorloom.operators import scores as E
from sensorloom.queries import inputs as I
from sensorloom.queries.catalog import query


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_mask(I.grid(spark, sf_dir))


def _sums(windows: DataFrame, key: str) -> DataFrame:
    """Windows by size and position-weighted sums, which any change of order or value moves."""
    weighted = lambda c: F.round(F.aggregate(F.transform(c, lambda v, k: F.coalesce(v, F.lit(0.0)) * (k + 1)), F.lit(0.0), lambda a, v: a + v), 3)
    return windows.select("sensor_id", key, F.size("x").alias("n_x"), F.size("y").alias("n_y"), weighted("x").alias("x_sum"), weighted("y").alias("y_sum"), F.size(F.filter("y_missing", lambda m: m)).alias("n_missing"))


@query(f"""with {I.GRID}, w as (
  select sensor_id, ts, count(value) over s n, count(*) over s r, list(value) over (partition by sensor_id order by ts rows between current row and 5 following) xs,
         lead(value, 6) over (partition by sensor_id order by ts) y
  from grid window s as (partition by sensor_id order by ts rows between current row and 6 following))
select sensor_id, ts, xs[1] x_first, xs[6] x_last, list_sum(xs) x_sum, y, false y_missing from w where n = 7 and r = 7""")
def w1_sensor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.sensor_windows(_masked(spark, sf_dir), 6)
    return w.select("sensor_id", "ts", F.col("x")[0].alias("x_first"), F.col("x")[5].alias("x_last"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x_sum"), "y", "y_missing")


@query(f"""with {I.FILLED}, holed as (select sensor_id, ts, is_missing, case when hour(ts) = 3 and day(ts) % 3 = 0 then null else value end as value from filled), w as (
  select sensor_id, ts, count(value) over s n, count(*) over s r, list(value) over (partition by sensor_id order by ts rows between current row and 23 following) xs,
         lead(value, 24) over o y, lead(is_missing, 24) over o y_missing
  from holed window s as (partition by sensor_id order by ts rows between current row and 24 following), o as (partition by sensor_id order by ts))
select sensor_id, ts, xs[1] x_first, xs[24] x_last, list_sum(xs) x_sum, y, y_missing from w where n = 25 and r = 25""")
def w1_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day in, an hour out, of a filled grid: some of the targets were missing."""
    w = S.sensor_windows(_holed(spark, sf_dir), 24)
    return w.select("sensor_id", "ts", F.col("x")[0].alias("x_first"), F.col("x")[23].alias("x_last"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x_sum"), "y", "y_missing")


# Windows of the whole network need hours at which every sensor has a value: the grid is filled but for some hours of the day.
_HOLED = I.FILLED + ", holed as (select sensor_id, ts, t_idx, is_missing, case when hour(ts) = 3 and day(ts) % 3 = 0 then null else value end as value from filled), h as (select max(t_idx) hi from holed)"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.prepared(spark, sf_dir).withColumn("value", F.when(~((F.hour("ts") == 3) & (F.day("ts") % 3 == 0)), F.col("value")))


def _window_sql(inputs: list[int], outputs: list[int], span: int, whole: bool) -> str:
    used = sorted({*inputs, *outputs})
    sums = lambda offsets: " + ".join(f"coalesce(max(case when k = {k} then value end), 0) * {n + 1}" for n, k in enumerate(offsets))
    valid = f"and s.start in (select t_idx - k from holed, k group by 1 having count(*) filter (value is null) = 0)" if whole else ""
    return f"""with {_HOLED}, k as (select unnest({used}) k), starts as (select distinct t_idx start from holed, h where t_idx + {span} - 1 <= hi)
select sensor_id, s.start, {len(inputs)} n_x, {len(outputs)} n_y, round({sums(inputs)}, 3) x_sum, round({sums(outputs)}, 3) y_sum,
       count(*) filter (is_missing and k in ({', '.join(map(str, outputs))})) n_missing
from starts s, k join holed on t_idx = s.start + k where true {valid} group by sensor_id, s.start"""


@query(_window_sql(list(range(8)), [8, 9], 10, True))
def w2_network_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(S.network_windows(_holed(spark, sf_dir), 8, 2), "start")


@query(_window_sql(list(range(8)), [10], 11, True))
def w3_single_step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(S.single_step_windows(_holed(spark, sf_dir), 8, 3), "start")


@query(f"""with {_HOLED}, k as (select unnest([0,1,2,3,4,5,6,7,10]) k), ok as (select t_idx - k s from holed, k, h where t_idx - k >= 0 and t_idx - k + 10 <= hi group by 1 having count(*) filter (value is null) = 0)
select cast(hi + 2 - 11 as bigint) n_windows, (select count(*) from ok) n_valid, round((select count(*) from ok) * 100.0::double / (hi + 2 - 11), 6) as percent from h""")
def w3_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retention(_holed(spark, sf_dir), 8, 3).withColumn("percent", F.round("percent", 6))


@query(_window_sql(list(range(6)), [6, 7, 8], 9, False))
def w4_all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(S.all_windows(_holed(spark, sf_dir), 6, 3), "start")


# The shape that all models take: a day in, an hour out.


@query(_window_sql(list(range(24)), [24], 25, True))
def w2_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(S.network_windows(_holed(spark, sf_dir)), "start")


@query(_window_sql(list(range(24)), [24], 25, True))
def w3_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(S.single_step_windows(_holed(spark, sf_dir)), "start")


@query(_window_sql(list(range(24)), [24], 25, False))
def w4_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(S.all_windows(_holed(spark, sf_dir)), "start")


@query(f"with {I.GRID} select sensor_id, ts, round((hour(ts) * 60 + minute(ts)) / 1440.0::double, 6) tod, cast(isodow(ts) - 1 as integer) dow, cast(isodow(ts) = 6 as double) is_saturday from grid")
def w5_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.grid(spark, sf_dir).select("sensor_id", "ts", F.round(S.time_of_day(), 6).alias("tod"), S.day_of_week().alias("dow"), S.day_of_week(one_hot=True)[5].alias("is_saturday"))


@query(f"""with {I.GRID}, s as (select sensor_id, row_number() over (order by sensor_id) - 1 node_idx from ids)
select cast(t_idx as integer) t_idx, ts, cast(node_idx as integer) node_idx, sensor_id, round(value, 4) f_value, round(hour(ts) / 24.0::double, 4) f_tod, cast(isodow(ts) - 1 as double) f_dow from grid join s using (sensor_id)""")
def w6_feature_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = S.feature_cube(I.grid(spark, sf_dir), I.traffic_sensors(spark, sf_dir))
    parts = [F.round(F.col("features")[k].cast("double"), 4).alias(name) for k, name in enumerate(("f_value", "f_tod", "f_dow"))]
    return cube.select("t_idx", "ts", "node_idx", "sensor_id", *parts)


@query(f"with {I.GRID}, {I.LINKS} select (select count(*) from ids) cube_sensors, (select count(*) from links) graph_sensors, (select count(*) from ids) = (select count(*) from links) compatible")
def w7_check_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.check_cube(S.feature_cube(I.grid(spark, sf_dir), I.traffic_sensors(spark, sf_dir)), I.sensors(spark, sf_dir))


_TRAIN = I.GRID + ", n as (select floor((max(t_idx) + 1) * 0.8) steps from grid), train as (select grid.* from grid, n where t_idx < steps)"


@query(f"with {_TRAIN} select min(value) lo, max(value) hi from train")
def w8_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fit_scaler(G.train_validation(I.grid(spark, sf_dir))[0])


@query(f"""with {_TRAIN}, a as (select *, count(value) over (partition by sensor_id order by ts rows between current row and 8 following) n from train),
b as (select *, max(n) over (partition by sensor_id order by ts rows between 8 preceding and current row) best from a)
select min(value) lo, max(value) hi from b where best = 9""")
def w8_strict_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fit_scaler(G.train_validation(I.grid(spark, sf_dir))[0], "strict", 8)


@query(f"with {_TRAIN}, s as (select min(value) lo, max(value) hi from train) select sensor_id, ts, round((value - lo) / case when hi = lo then 1 else hi - lo end, 6) as value from grid, s")
def w9_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.grid(spark, sf_dir)
    return S.scale(rows, S.fit_scaler(G.train_validation(rows)[0])).withColumn("value", F.round("value", 6))


@query(f"with {I.GRID} select sensor_id, ts, round(value, 6) as value from grid")
def w9_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled and back."""
    rows = I.grid(spark, sf_dir)
    scaler = S.fit_scaler(G.train_validation(rows)[0])
    return S.scale(S.scale(rows, scaler), scaler, inverse=True).withColumn("value", F.round("value", 6))


_SCORES = """round(avg(abs(y_true - y_pred)), 6) mae, round(sqrt(avg((y_true - y_pred) ** 2)), 6) rmse,
round(coalesce(avg(case when abs(y_true) + abs(y_pred) <> 0 then abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) end) * 100, 0), 6) smape,
round(sum(abs(y_true - y_pred)) / sum(y_true), 6) wmape"""


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "smape", "wmape")})


@query(f"with {I.PREDICTIONS} select {_SCORES} from predictions")
def e1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE, RMSE, sMAPE and WMAPE of all cells."""
    return _rounded(E.score(I.predictions(spark, sf_dir)))


@query(f"with {I.PREDICTIONS} select sensor_id, {_SCORES} from predictions group by sensor_id")
def e2_scores_by_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.score(I.predictions(spark, sf_dir), "sensor_id"))


@query(f"with {I.PREDICTIONS} select {_SCORES} from predictions where not is_missing")
def e3_observed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.observed_only(I.predictions(spark, sf_dir)))


@query(f"with {I.PREDICTIONS} select count(*) n_total, count(*) filter (not is_missing) n_observed, count(*) filter (is_missing) n_imputed, round(count(*) filter (not is_missing) * 100.0::double / count(*), 6) observed_percent from predictions")
def e4_cell_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cell_shares(I.predictions(spark, sf_dir)).withColumn("observed_percent", F.round("observed_percent", 6))


@query(f"with {I.PREDICTIONS} select cast(horizon as integer) horizon, round(avg(abs(y_true - y_pred)), 6) mae from predictions where horizon in (3, 6, 12) group by horizon")
def e5_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.at_horizons(I.predictions(spark, sf_dir)).withColumn("mae", F.round("mae", 6))


@query(f"with {I.PREDICTIONS} select cast(horizon as integer) horizon, round(sum(abs(y_true - y_pred)) / sum(y_true), 6) wmape from predictions group by horizon")
def e6_wmape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.predictions(spark, sf_dir).groupBy("horizon").agg(F.round(E.wmape(), 6).alias("wmape"))
