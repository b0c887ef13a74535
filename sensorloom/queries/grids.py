"""Queries on the hourly grid, masks and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import grid as G
from sensorloom.queries import inputs as I
from sensorloom.queries.catalog import query

_CUT = "2024-01-21 23:59:59"
_RAW = f"""with {I.TRAFFIC},
wide as (
  select strftime(ts, '%Y-%m-%d') d, sensor_id, {', '.join(f"max(case when hour(ts) = {h} then value end) h{h}" for h in range(24))} from traffic group by 1, 2),
again as (select sensor_id, d from wide where (dayofyear(cast(d as date)) + cast(right(sensor_id, 7) as bigint)) % 10 = 0),
cells as ({' union all '.join(f"select sensor_id, cast(d as timestamp) + interval {h} hour ts, h{h} as value from wide" for h in range(24))})"""


@query(f"""with {I.CLEAN},
c2 as (select *, value is null miss from clean),
f as (select *, round_even(coalesce(value, avg(value) over (partition by sensor_id, hour(ts))), 0) fill from c2)
select sensor_id, avg(cast(miss as int)) missing_rate, round(avg(fill), 6) mean_value, count(*) n_hours from f group by sensor_id""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw events to a cleaned, filled series: missing rate and mean of each sensor."""
    return I.prepared(spark, sf_dir, I.fresh_grid(spark, sf_dir)).groupBy("sensor_id").agg(F.avg(F.col("is_missing").cast("int")).alias("missing_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n_hours"))


@query(_RAW + """,
late as (select sensor_id, cast(d as timestamp) d from again)
select c.sensor_id, c.ts,
       case when l.d is null then value when hour(c.ts) = 3 then 7.0 when hour(c.ts) = 4 then null else value end as value
from cells c left join late l on l.sensor_id = c.sensor_id and l.d = date_trunc('day', c.ts)""")
def t1_last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days repeated under a later seq replace earlier ones, also by NULL."""
    return G.from_hour_columns(I.raw_counts(spark, sf_dir))


@query(_RAW + " select sensor_id, ts, value from cells")
def t1_hours_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide raw counts to the long table."""
    return G.from_hour_columns(I.raw_counts(spark, sf_dir).where("seq < 10000000000"))


@query(f"with {I.GRID} select sensor_id, ts, value from grid where sensor_id in (select sensor_id from grid where value > 19 group by 1)")
def t2_drop_never_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors with a value left after small counts were blanked."""
    g = I.grid(spark, sf_dir)
    kept = G.drop_never_observed(g.withColumn("value", F.when(F.col("value") > 19, F.col("value"))))
    return g.join(kept.select("sensor_id").distinct(), "sensor_id", "left_semi")


@query(f"with {I.TRAFFIC} select sensor_id, ts, cast(round_even(value / 8, 0) as integer) as value from traffic")
def t3_cast_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cast_values(I.traffic(spark, sf_dir).withColumn("value", F.col("value") / 8), "int")


@query(f"with {I.GRID} select sensor_id, ts, value from grid")
def t4_regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fresh_grid(spark, sf_dir)


@query(f"with {I.TRAFFIC}, g as (select distinct ts from traffic), s as (select date_diff('hour', lag(ts) over (order by ts), ts) gap from g) select cast(min(gap) as integer) step_hours from s having count(distinct gap) = 1")
def t4_infer_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequency of the table's times."""
    return spark.range(1).select(F.lit(G.step_hours(I.traffic(spark, sf_dir))).cast("int").alias("step_hours"))


@query(f"with {I.TRAFFIC} select count(*) n_rows, count(distinct sensor_id || ts) n_keys from traffic")
def t5_check_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.check_order(I.traffic(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sensor_id", "ts").alias("n_keys"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other link, most of them without traffic."""
    return I.sensors(spark, sf_dir).where("idx % 2 = 0")


_TARGETS = I.GRID + ", " + I.LINKS + ", sensors as (select row_number() over (order by LINK_ID) - 1 idx, LINK_ID sensor_id from links), targets as (select * from sensors where idx % 2 = 0)"


@query(f"with {_TARGETS} select g.sensor_id, idx, ts, value from grid g join targets using (sensor_id)")
def t6_select_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.select_sensors(I.grid(spark, sf_dir), _targets(spark, sf_dir))[0].select("sensor_id", "idx", "ts", "value")


@query(f"with {_TARGETS} select sensor_id from targets where sensor_id not in (select sensor_id from traffic)")
def t6_unknown_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.select_sensors(I.grid(spark, sf_dir), _targets(spark, sf_dir))[1].select("sensor_id")


@query(f"with {_TARGETS} select sensor_id, ts, value, value is null is_missing from grid where sensor_id in (select LINK_ID from links where left(LINK_ID, 3) in ('161', '163', '165', '167'))")
def t7_match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorloom.operators.roadnet import region_filter

    return G.match_links(I.grid(spark, sf_dir), region_filter(I.links(spark, sf_dir), ["161", "163", "165", "167"], "LINK_ID"))


@query(f"with {_TARGETS} select sensor_id, ts, value from grid semi join targets using (sensor_id)")
def t8_keep_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keep_sensors(I.grid(spark, sf_dir), _targets(spark, sf_dir))


@query(f"with {I.GRID} select sensor_id, ts, value from grid where ts >= '2024-01-05 06:00:00' and ts <= '2024-01-20 18:00:00'")
def t9_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.time_range(I.grid(spark, sf_dir), "2024-01-05 06:00:00", "2024-01-20 18:00:00")


@query(f"with {I.CLEAN} select sensor_id, ts, value from clean where sensor_id in (select sensor_id from clean group by 1 having avg(cast(value is null as int)) < 0.75)")
def t10_missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorloom.operators.outliers import absolute_limit, chain, zeros_beside_gaps

    return G.filter_missing_rate(chain(I.grid(spark, sf_dir), [absolute_limit(3450), zeros_beside_gaps()]), 0.75)


@query(f"""with {I.TRAFFIC}, halves as (select *, ts >= '2024-01-15' late from traffic),
b as (select late, min(ts) lo, max(ts) hi from halves group by late), s as (select distinct late, sensor_id from halves),
h as (select late, unnest(generate_series(lo, hi, interval 1 hour)) ts from b)
select s.sensor_id, h.ts, t.value, s.late from s join h using (late) left join traffic t on t.sensor_id = s.sensor_id and t.ts = h.ts""")
def t11_split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = G.split_at(I.traffic(spark, sf_dir), "2024-01-15")
    return early.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


@query(f"with {I.GRID} select 'train' part, sensor_id, ts, value from grid where ts <= '{_CUT}' union all select 'test', sensor_id, ts, value from grid where ts >= '{_CUT}'")
def t12_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = G.train_test(I.grid(spark, sf_dir), _CUT)
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


@query(f"with {I.CLEAN} select sensor_id, ts, value, value is null is_missing from clean")
def m1_missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorloom.operators.outliers import absolute_limit, chain, zeros_beside_gaps

    return G.with_mask(chain(I.grid(spark, sf_dir), [absolute_limit(3450), zeros_beside_gaps()]))


@query(f"with {I.GRID} select sensor_id, ts, value, value is null and ts <= '{_CUT}' is_missing from grid")
def m2_align_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.grid(spark, sf_dir)
    return G.align_mask(rows, G.with_mask(G.time_range(rows, end=_CUT)))


@query(f"with {I.GRID}, s as (select sensor_id, row_number() over (order by sensor_id) - 1 node_idx from ids) select sensor_id, ts, value, cast(node_idx as integer) node_idx from grid join s using (sensor_id)")
def m3_graph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_order(I.grid(spark, sf_dir), I.traffic_sensors(spark, sf_dir))


@query(f"with {I.GRID}, n as (select floor((max(t_idx) + 1) * 0.8) steps from grid) select sensor_id, ts, value, t_idx < steps in_train from grid, n")
def m4_train_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rest = G.train_validation(I.grid(spark, sf_dir))
    return train.withColumn("in_train", F.lit(True)).unionByName(rest.withColumn("in_train", F.lit(False))).drop("t_idx")


@query(f"with {I.GRID}, s as (select sensor_id, row_number() over (order by sensor_id) - 1 i from ids) select sensor_id, ts, value from grid join s using (sensor_id) where i % 3 = 0")
def m5_restrict_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.restrict_to(I.grid(spark, sf_dir), I.traffic_sensors(spark, sf_dir).where("idx % 3 = 0"))
