"""Queries of the model-based fills and of whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators import model_fills as K
from sensorloom.operators import neighbours as N
from sensorloom.operators.factorize import bgcp_fill, trmf_fill
from sensorloom.operators.roadnet import bounded_distances, gaussian_adjacency, top_neighbours
from sensorloom.operators.subset import make_subset
from sensorloom.plans.scratch import written, written_once
from sensorloom.queries import inputs as I
from sensorloom.queries.catalog import query

_AVERAGE = I.GRID + """,
raw as (select ts, any_value(t_idx) t, avg(value) v from grid group by ts),
near as (
  select *, last_value(v ignore nulls) over b bv, last_value(case when v is not null then t end ignore nulls) over b bt,
         first_value(v ignore nulls) over f fv, first_value(case when v is not null then t end ignore nulls) over f ft
  from raw window b as (order by ts rows between unbounded preceding and current row), f as (order by ts rows between current row and unbounded following)),
lined as (select ts, coalesce(v, bv + (fv - bv) * ((t - bt)::double / nullif(ft - bt, 0)), bv) as value from near),
average as (select ts, coalesce(value, (select avg(value) from lined)) as value from lined)"""


@query(f"with {_AVERAGE} select ts, round(value, 6) as value from average")
def p1_network_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.network_average(I.grid(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"with {I.ADJACENCY}, r as (select src target, dst neighbour, row_number() over (partition by src order by round(weight, 9) desc, dst_idx) as rank from adjacency where src <> dst and weight > 0) select target, neighbour, cast(rank as integer) as rank from r where rank <= 10")
def p2_top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_neighbours(I.adjacency(spark, sf_dir).withColumn("weight", F.round("weight", 9)), 10)


def _dense_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of the traffic sensors in which each has ten neighbours or more, if there are: sensors k steps apart in the order of ids are k apart."""
    s = I.traffic_sensors(spark, sf_dir)
    n = s.count()
    near = s.select(F.col("sensor_id").alias("from"), "idx", F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("k"))
    other = s.select(F.col("sensor_id").alias("to"), F.col("idx").alias("at"))
    pairs = near.join(other, F.pmod(F.col("idx") + F.col("k"), F.lit(n)) == F.col("at")).select("from", "to", F.abs("k").cast("double").alias("distance"))
    pairs = pairs.groupBy("from", "to").agg(F.min("distance").alias("distance"))  # few sensors are met both ways round
    return written(gaussian_adjacency(pairs, s, 0.01))


#: The graph of ``_dense_adjacency``; ``nearest``: each sensor's heaviest neighbours.
_DENSE = """tids as (select sensor_id, row_number() over (order by sensor_id) - 1 idx, count(*) over () n from (select distinct sensor_id from traffic)),
ring as (
  select a.sensor_id f, b.sensor_id t, b.idx t_idx, cast(min(abs(k)) as double) distance
  from (select *, unnest(range(-12, 13)) k from tids) a join tids b on ((a.idx + a.k) % a.n + a.n) % a.n = b.idx group by 1, 2, 3),
ring_spread as (select stddev_pop(distance) s from ring),
ring_weights as (select f, t, t_idx, exp(-(distance / s) * (distance / s)) w from ring, ring_spread where f <> t and exp(-(distance / s) * (distance / s)) >= 0.01),
nearest as (select f target, t sensor_id, row_number() over (partition by f order by round(w, 12) desc, t_idx) as rank from ring_weights)"""


def _traffic_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The road graph's adjacency of the traffic sensors, by paths of up to 9000."""

    def make() -> DataFrame:
        s = I.traffic_sensors(spark, sf_dir)
        links = I.links(spark, sf_dir)
        placed = s.join(links.select(F.col("LINK_ID").alias("sensor_id")), "sensor_id", "left_semi")
        return gaussian_adjacency(bounded_distances(I.road_graph(spark, sf_dir), placed, I.LIMIT, links), s, unique=True)

    return written_once(spark, make, "traffic adjacency", sf_dir)


#: The graph of ``_traffic_adjacency``, likewise.
_ROADS = """tids as (select sensor_id, row_number() over (order by sensor_id) - 1 idx from (select distinct sensor_id from traffic)),
own as (select "from" f, "to" t, idx t_idx, distance from distances join tids on sensor_id = "to" where "from" in (select sensor_id from tids)),
own_spread as (select stddev_pop(distance) s from own),
nearest as (
  select f target, t sensor_id, row_number() over (partition by f order by distance, t_idx) as rank from own, own_spread
  where f <> t and exp(-(distance / s) * (distance / s)) >= 0.1)"""

_SLICES = """gaps as (select sensor_id target from grid group by 1 having count(*) > count(value)),
cells as materialized (
  select target, 0 as rank, ts, value from gaps join grid on sensor_id = target union all
  select nearest.target, rank, ts, value from nearest join gaps using (target) join grid using (sensor_id) where rank <= 10 union all
  select target, 99, ts, average.value from gaps cross join average)"""
_POSITIONS = "select target, ts, row_number() over (partition by target, ts order by rank) - 1 as position, round(value, 6) as value from cells"
_ON_ROADS = f"with {I.DISTANCES}, {_AVERAGE}, {_ROADS}, {_SLICES}"


def _positions(spark: SparkSession, sf_dir: str, adjacency: DataFrame) -> DataFrame:
    rows = I.grid(spark, sf_dir)
    s = N.neighbour_slices(rows, adjacency, N.network_average(rows))
    features = s.select("target", "ts", F.posexplode("features").alias("position", "value"))
    return features.withColumn("value", F.when(~F.isnan("value"), F.round("value", 6)))


@query(f"{_ON_ROADS} {_POSITIONS}")
def p3_neighbour_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each sensor and hour, a row for each; null where missing."""
    return _positions(spark, sf_dir, _traffic_adjacency(spark, sf_dir))


@query(f"with {_AVERAGE}, {_DENSE}, {_SLICES} {_POSITIONS}")
def p3_ring_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a graph in which each sensor has ten neighbours."""
    return _positions(spark, sf_dir, _dense_adjacency(spark, sf_dir))


#: Every missing hour against every observed one.
_KNN = """pairs as (
  select a.target, a.ts, b.ts donor, sum((a.value - b.value) * (a.value - b.value)) * (select count(distinct rank) from cells c where c.target = a.target) / count(*) far
  from cells a join cells b using (target, rank)
  where a.value is not null and b.value is not null
    and exists (select 1 from cells m where m.target = a.target and m.rank = 0 and m.ts = a.ts and m.value is null)
    and exists (select 1 from cells m where m.target = b.target and m.rank = 0 and m.ts = b.ts and m.value is not null)
  group by a.target, a.ts, b.ts),
nearest_hours as (select *, row_number() over (partition by target, ts order by far, donor) place from pairs),
found as (select target, n.ts, avg(g.value) v from nearest_hours n join grid g on g.sensor_id = target and g.ts = donor where place <= 5 group by 1, 2)
select sensor_id, g.ts, round(coalesce(value, v, avg(value) over (partition by sensor_id)), 6) as value from grid g left join found f on f.target = sensor_id and f.ts = g.ts"""


@query(f"{_ON_ROADS}, {_KNN}")
def p4_knn_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.knn_fill(I.grid(spark, sf_dir), _traffic_adjacency(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"with {_AVERAGE}, {_DENSE}, {_SLICES}, {_KNN}")
def p4_ring_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ten neighbours for each sensor."""
    return K.knn_fill(I.grid(spark, sf_dir), _dense_adjacency(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fill that takes long, written once for the query that returns it and the one that tests it."""
    rows = I.grid(spark, sf_dir)
    make = {
        "mice": lambda: K.mice_fill(rows, _traffic_adjacency(spark, sf_dir)),
        "temporal mice": lambda: K.temporal_mice_fill(rows),
        "trmf": lambda: trmf_fill(rows),
        "bgcp": lambda: bgcp_fill(rows),
    }
    return written_once(spark, make[name], name, sf_dir)


def _kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """By sensor: its cells, those that the fill has changed though observed, left NULL, or put outside what the sensor has shown."""
    shown = I.grid(spark, sf_dir).select("sensor_id", "ts", F.col("value").alias("was"), *[f("value").over(Window.partitionBy("sensor_id")).alias(n) for n, f in (("least", F.min), ("most", F.max))])
    both = _model(spark, sf_dir, name).join(shown, ["sensor_id", "ts"], "full")
    outside = (F.col("value") < F.col("least") - 1e-9) | (F.col("value") > F.col("most") + 1e-9)
    return both.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("was").alias("n_observed"),
        F.count_if(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("value"))).alias("n_changed"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count_if(outside).alias("n_outside"),
    )


_KEPT = f"with {I.GRID} select sensor_id, count(*) n_cells, count(value) n_observed, 0::bigint n_changed, 0::bigint n_null, 0::bigint n_outside from grid group by 1"


@query(None)
def p5_mice_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "mice")


@query(_KEPT)
def p5_mice_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "mice")


@query(f"""with {_AVERAGE}, s as (
  select ts, value avg0, coalesce(lag(value, 1) over (order by ts), value) avg1, coalesce(lag(value, 2) over (order by ts), value) avg2 from average),
r as (select sensor_id, ts, value, row_number() over w n, lag(value, 1) over w l1, lag(value, 2) over w l2, lag(value, 3) over w l3 from grid window w as (partition by sensor_id order by ts))
select sensor_id, ts, r.value, round(avg0, 6) avg0, round(avg1, 6) avg1, round(avg2, 6) avg2,
       round(sin(hour(ts) * 2 * pi() / 24), 6) hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) hour_cos,
       round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) day_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) day_cos,
       case when n <= 1 then r.value else l1 end lag1, case when n <= 2 then r.value else l2 end lag2, case when n <= 3 then r.value else l3 end lag3
from r join s using (ts)""")
def p6_temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.grid(spark, sf_dir)
    f = N.temporal_features(rows, N.network_average(rows))
    return f.withColumns({c: F.round(c, 6) for c in ("avg0", "avg1", "avg2", "hour_sin", "hour_cos", "day_sin", "day_cos")})


@query(None)
def p6_temporal_mice_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "temporal mice")


@query(_KEPT)
def p6_temporal_mice_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "temporal mice")


@query(None)
def p7_trmf_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "trmf")


#: A low-rank model may leave the range of what was seen.
_KEPT_IN_ANY_RANGE = _KEPT.replace(", 0::bigint n_outside", "")


@query(_KEPT_IN_ANY_RANGE)
def p7_trmf_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "trmf").drop("n_outside")


@query(None)
def p8_bgcp_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "bgcp")


@query(_KEPT_IN_ANY_RANGE)
def p8_bgcp_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "bgcp").drop("n_outside")


@query(f"""with {I.GRID}, s as (select *, avg(value) over (partition by sensor_id) mean, stddev_pop(value) over (partition by sensor_id) sd from grid)
select cast(t_idx // 24 as bigint) segment, sensor_id, count(*) n_steps, round(coalesce(sum((value - mean) / case when sd > 0 then sd else 1 end * (t_idx % 24 + 1)), 0), 4) z_sum
from s where t_idx < (select (max(t_idx) + 1) // 24 * 24 from grid) group by 1, 2""")
def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = N.standardized_segments(I.grid(spark, sf_dir))
    z = F.aggregate(F.transform("steps", lambda v, k: F.coalesce(v, F.lit(0.0)) * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return segments.select("segment", "sensor_id", F.size("steps").cast("long").alias("n_steps"), F.round(z, 4).alias("z_sum"))


@query(f"with {I.GRID} select sensor_id, ts, round(value, 6) imputed from grid where t_idx < (select (max(t_idx) + 1) // 24 * 24 from grid)")
def p9_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and back to counts."""
    rows = I.grid(spark, sf_dir)
    return N.unscaled(N.standardized_segments(rows)[0], rows).withColumn("imputed", F.round("imputed", 6))


_CUT = "2024-01-21 23:59:59"


@query(f"""with {I.CLEAN}, f as (select sensor_id, ts, value is null is_missing, round_even(coalesce(value, avg(value) over (partition by sensor_id, hour(ts))), 0) as value from clean),
tr as (select sensor_id, ts, value is null is_missing, round_even(coalesce(value, avg(value) over (partition by sensor_id, hour(ts))), 0) as value from clean where ts <= '{_CUT}')
select 'full' part, sensor_id, ts, value, is_missing from f union all select 'train', * from (select sensor_id, ts, value, is_missing from tr) union all select 'test', sensor_id, ts, value, is_missing from f where ts >= '{_CUT}'""")
def a_dataset_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw counts to full, training and test parts with their masks."""
    parts = make_subset(I.traffic(spark, sf_dir), cut=_CUT, missing_rate=1.0)
    out = [parts[p].join(parts[f"{p}_missing"], ["sensor_id", "ts"]).select(F.lit(p).alias("part"), "sensor_id", "ts", "value", "is_missing") for p in ("full", "train", "test")]
    return out[0].union(out[1]).union(out[2])
