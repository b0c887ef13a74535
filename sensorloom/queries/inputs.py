"""Sensor tables derived from the driver's star schema: Spark on one side, SQL on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators.fills import hour_mean
from sensorloom.operators.grid import regular_grid, with_mask
from sensorloom.operators.outliers import absolute_limit, chain, zeros_beside_gaps
from sensorloom.operators.roadnet import apply_turns, bounded_distances, gaussian_adjacency, link_edges
from sensorloom.plans.scratch import made_once, written_once

#: Longest path between two sensors.
LIMIT = 9000.0
HOLIDAYS = ("2024-01-01", "2024-01-09", "2024-01-10")


def _id(k: Column) -> Column:
    return F.concat(F.lpad((161 + k % 12).cast("string"), 3, "0"), F.lpad(k.cast("string"), 7, "0"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of sensors, from ``events``; about half the cells are absent."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    n_sensors = max(5, events.count() // 500)
    hourly = events.groupBy((F.col("user_id") % n_sensors).cast("long").alias("s"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("total"))
    return hourly.select(_id(F.col("s")).alias("sensor_id"), "ts", F.floor(F.round(F.col("total"), 2) / 20).cast("double").alias("value"))


TRAFFIC = """m as (select greatest(5, count(*)//500) m from events),
traffic as (
  select lpad(cast(161 + s % 12 as varchar), 3, '0') || lpad(cast(s as varchar), 7, '0') sensor_id, ts, cast(floor(round(sum(value), 2)/20) as double) as value
  from (select e.user_id % m.m s, date_trunc('hour', e.ts) ts, e.value from events e, m) group by s, ts)"""

GRID = TRAFFIC + """,
bounds as (select min(ts) lo, max(ts) hi from traffic),
ids as (select distinct sensor_id from traffic),
hrs as (select unnest(generate_series(lo, hi, interval 1 hour)) ts from bounds),
grid as (
  select i.sensor_id, h.ts, t.value, date_diff('hour', lo, h.ts) t_idx
  from ids i cross join hrs h cross join bounds left join traffic t on t.sensor_id = i.sensor_id and t.ts = h.ts)"""


def fresh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(traffic(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, made once for each path of tables and kept by sensor, as most queries begin with it."""
    return written_once(spark, lambda: fresh_grid(spark, sf_dir), "grid", sf_dir, by=("sensor_id",))


def prepared(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The grid, or another one, after the default outlier steps, with its mask and filled by hour means."""
    rows = with_mask(chain(grid(spark, sf_dir) if rows is None else rows, [absolute_limit(3450), zeros_beside_gaps()]))
    return hour_mean()(rows)


CLEAN = GRID + """,
lim as (select sensor_id, ts, t_idx, case when abs(value) <= 3450 then value end as value from grid),
runs as (select *, count(case when value <> 0 then 1 end) over (partition by sensor_id order by ts rows unbounded preceding) run from lim),
clean as (
  select sensor_id, ts, t_idx, case when value = 0 and bool_or(value is null) over (partition by sensor_id, run) then null else value end as value from runs)"""

FILLED = CLEAN + """,
filled as (
  select sensor_id, ts, t_idx, value is null is_missing,
         round_even(coalesce(value, avg(value) over (partition by sensor_id, hour(ts))), 0) as value from clean)"""


def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts as rows of a day, a tenth of which are repeated later with other values."""
    rows = traffic(spark, sf_dir).withColumn("statDate", F.date_format("ts", "yyyy-MM-dd")).withColumnRenamed("sensor_id", "linkID")
    wide = rows.groupBy("statDate", "linkID").agg(*[F.max(F.when(F.hour("ts") == h, F.col("value"))).alias(f"hour{h:02d}") for h in range(24)])
    turn = F.dayofyear(F.to_date("statDate")) + F.substring("linkID", 4, 7).cast("long")
    wide = wide.withColumn("seq", turn.cast("long"))
    again = wide.where(F.col("seq") % 10 == 0).withColumns({"seq": F.col("seq") + 10_000_000_000, "hour03": F.lit(7.0), "hour04": F.lit(None).cast("double")})
    return wide.unionByName(again)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road links, from ``supplier``; ids line up with the sensors."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_acctbal").cast("double").alias("bal"))
    n = max(3, supplier.count() // 3)
    a, c = F.floor(F.abs("bal") * 0.06) + 1, F.floor(F.abs("bal") * 0.04) + 1
    x, y = F.col("k") % 50 * 100.0, F.col("k") % 37 * 100.0
    point = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
    return supplier.select(
        _id(F.col("k")).alias("LINK_ID"),
        _id((F.col("k") * 7 + 3) % n).alias("F_NODE"),
        _id((F.col("k") * 11 + 5) % n).alias("T_NODE"),
        (1 + F.col("k") % 4).cast("int").alias("LANES"),
        (60 + 10 * (F.col("k") % 6)).cast("int").alias("MAX_SPD"),
        F.concat(F.lit("road "), F.col("k").cast("string")).alias("ROAD_NAME"),
        (101 + F.col("k") % 7).cast("string").alias("ROAD_RANK"),
        (F.col("k") % 3).cast("string").alias("ROAD_TYPE"),
        (F.col("k") % 2).cast("string").alias("REST_VEH"),
        F.array(point(x, y), point(x + a, y), point(x + a, y + c)).alias("geometry"),
    )


LINKS = """n as (select greatest(count(*)//3, 3) n from supplier),
base as (
  select s_suppkey k, (s_suppkey*7+3) % n f, (s_suppkey*11+5) % n t,
         floor(abs(s_acctbal)*0.06)+1 a, floor(abs(s_acctbal)*0.04)+1 c, k % 50 * 100.0 x, k % 37 * 100.0 y from supplier, n),
links as (
  select lpad(cast(161 + k % 12 as varchar), 3, '0') || lpad(cast(k as varchar), 7, '0') LINK_ID,
         lpad(cast(161 + f % 12 as varchar), 3, '0') || lpad(cast(f as varchar), 7, '0') F_NODE,
         lpad(cast(161 + t % 12 as varchar), 3, '0') || lpad(cast(t as varchar), 7, '0') T_NODE,
         cast(1 + k % 4 as integer) LANES, cast(60 + 10 * (k % 6) as integer) MAX_SPD, 'road ' || k ROAD_NAME, cast(101 + k % 7 as varchar) ROAD_RANK,
         cast(k % 3 as varchar) ROAD_TYPE, cast(k % 2 as varchar) REST_VEH, cast(a + c as double) len, cast(x as double) x, cast(y as double) y, cast(a as double) a, cast(c as double) c from base)"""

EDGES = LINKS + """,
edges as (
  select s.LINK_ID src, e.LINK_ID dst, s.T_NODE intersection_id, (s.len + e.len) / 2 as length
  from links s join links e on s.T_NODE = e.F_NODE where s.F_NODE <> e.T_NODE)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_edges(links(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn rules, from links and edges."""
    number = lambda c: F.substring(c, -7, 7).cast("long")
    e = edges(spark, sf_dir).where((number("src") + number("dst")) % 5 == 0)
    removed = e.select(F.col("intersection_id").alias("NODE_ID"), F.col("src").alias("ST_LINK"), F.col("dst").alias("ED_LINK"), F.lit("101").alias("TURN_TYPE"), (2 * (number("src") * 1000 + number("dst"))).alias("row_no"))
    ahead = links(spark, sf_dir).withColumn("x", F.lead("LINK_ID", 7).over(Window.orderBy("LINK_ID"))).where(F.col("x").isNotNull() & (number("LINK_ID") % 3 == 0))
    return removed.union(ahead.select("T_NODE", "LINK_ID", "x", F.lit("011"), 100_000_001 + number("LINK_ID")))


TURNED = EDGES + """,
turns as (
  select intersection_id NODE_ID, src ST_LINK, dst ED_LINK, '101' TURN_TYPE, 2 * (cast(right(src, 7) as bigint) * 1000 + cast(right(dst, 7) as bigint)) row_no
  from edges where (cast(right(src, 7) as bigint) + cast(right(dst, 7) as bigint)) % 5 = 0
  union all
  select T_NODE, LINK_ID, x, '011', 100000001 + cast(right(LINK_ID, 7) as bigint)
  from (select T_NODE, LINK_ID, lead(LINK_ID, 7) over (order by LINK_ID) x from links)
  where x is not null and cast(right(LINK_ID, 7) as bigint) % 3 = 0),
rules as (
  select t.*, a.len la, b.len lb from turns t left join links a on a.LINK_ID = ST_LINK left join links b on b.LINK_ID = ED_LINK
  where TURN_TYPE not in ('001', '011', '012') or (a.len is not null and b.len is not null)),
last_rule as (
  select ST_LINK src, ED_LINK dst, arg_max(TURN_TYPE, row_no) tt, arg_max(NODE_ID, row_no) node, arg_max(la, row_no) la, arg_max(lb, row_no) lb from rules group by 1, 2),
turned as (
  select e.* from edges e anti join last_rule r on r.src = e.src and r.dst = e.dst
  union all
  select src, dst, node, (la + lb) / 2 from last_rule where tt in ('001', '011', '012'))"""


def turned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_turns(edges(spark, sf_dir), turns(spark, sf_dir), links(spark, sf_dir))


# The graph that the queries below the distances stand on is made once for each path of tables, when the first of them asks for it.


def road_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, lambda: turned_edges(spark, sf_dir), "edges", sf_dir)


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links as sensors, in the order of their ids."""
    ids = links(spark, sf_dir).select(F.col("LINK_ID").alias("sensor_id"))
    return ids.select((F.row_number().over(Window.orderBy("sensor_id")) - 1).alias("idx"), "sensor_id")


def traffic_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that have traffic."""
    ids = traffic(spark, sf_dir).select("sensor_id").distinct()
    return ids.select((F.row_number().over(Window.orderBy("sensor_id")) - 1).alias("idx"), "sensor_id")


def distances(spark: SparkSession, sf_dir: str, limit: float = LIMIT) -> DataFrame:
    """Between all sensors; too many pairs to keep, so each reader has its tasks make them again."""
    return made_once(spark, lambda: bounded_distances(road_graph(spark, sf_dir), sensors(spark, sf_dir), limit, links(spark, sf_dir)), "distances", sf_dir, limit)


DISTANCES = "recursive " + TURNED + """,
d0 as materialized (
  select source, node, min(distance) distance from (
    select LINK_ID source, LINK_ID node, cast(0 as double) distance from links union all select src, dst, length from turned where length <= 9000) group by 1, 2),
""" + "".join(
    f"""d{k + 1} as materialized (
  select a.source, b.node, min(a.distance + b.distance) distance from d{k} a join d{k} b on a.node = b.source where a.distance + b.distance <= 9000 group by 1, 2),
"""
    for k in range(7)  # paths of up to 128 edges
) + """distances as (select source "from", node "to", distance from d7)"""

ADJACENCY = DISTANCES + """,
sensors as (select row_number() over (order by LINK_ID) - 1 idx, LINK_ID sensor_id from links),
spread as (select stddev_pop(distance) s from distances),
adjacency as (
  select d."from" src, d."to" dst, a.idx src_idx, b.idx dst_idx, exp(-(distance / s) * (distance / s)) weight
  from distances d, spread, sensors a, sensors b
  where a.sensor_id = d."from" and b.sensor_id = d."to" and d."from" <> d."to" and exp(-(distance / s) * (distance / s)) >= 0.1
  union all select sensor_id, sensor_id, idx, idx, 1.0 from sensors)"""


def adjacency(spark: SparkSession, sf_dir: str, limit: float = LIMIT) -> DataFrame:
    return written_once(spark, lambda: gaussian_adjacency(distances(spark, sf_dir, limit), sensors(spark, sf_dir), unique=True), "adjacency", sf_dir, limit)


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public holidays within the span of ``events``."""
    dates = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("date")).distinct()
    return dates.where(F.col("date").cast("string").isin(*HOLIDAYS))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled grid against the value of the hour before."""
    before = F.lag("value").over(Window.partitionBy("sensor_id").orderBy("ts"))
    rows = prepared(spark, sf_dir).withColumn("y_pred", before).where("y_pred is not null")
    return rows.select("sensor_id", "ts", (1 + F.hour("ts") % 12).alias("horizon"), F.col("value").alias("y_true"), "y_pred", "is_missing")


PREDICTIONS = FILLED + """,
predictions as (
  select * from (select sensor_id, ts, 1 + hour(ts) % 12 horizon, value y_true, lag(value) over (partition by sensor_id order by ts) y_pred, is_missing from filled)
  where y_pred is not null)"""
