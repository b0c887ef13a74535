"""Queries of the sources and sinks: tables are written below the scratch folder and read back."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.grid import HOURS, with_mask
from sensorloom.operators.roadnet import link_locations, link_metadata
from sensorloom.plans.fingerprint import fingerprint, fingerprint_sql
from sensorloom.plans.scratch import scratch_folder
from sensorloom.queries import inputs as I
from sensorloom.queries.catalog import query
from sensorloom.sources import payloads as P
from sensorloom.sources import tables as T


def _folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/io-{uuid.uuid4().hex}"


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the raw counts, a day each, landed as JSON; day 5 has an odd code, and an empty day follows the last."""
    raw = I.raw_counts(spark, sf_dir).where("seq < 10000000000").select(F.struct("statDate", "linkID", *HOURS, "seq").alias("item"))
    days = raw.groupBy(F.col("item.statDate").alias("day")).agg(F.collect_list("item").alias("items"))
    code = F.when(F.col("day").endswith("-05"), "03").otherwise("00")
    answer = days.select("day", F.struct(F.struct(code.alias("resultCode")).alias("header"), F.struct("items").alias("body")).alias("response"))
    empty = spark.range(1).select(F.lit("2024-01-31").alias("day"), F.struct(F.struct(F.lit("00").alias("resultCode")).alias("header"), F.struct(F.array().cast(answer.schema["response"].dataType["body"].dataType["items"].dataType).alias("items")).alias("body")).alias("response"))
    path = _folder(spark)
    answer.union(empty).write.json(path)
    return P.read_payloads(spark, path)


_WIDE = f"with {I.TRAFFIC}, wide as (select strftime(ts, '%Y-%m-%d') d, sensor_id, {', '.join(f'max(case when hour(ts) = {h} then value end) h{h}' for h in range(24))} from traffic group by 1, 2)"


@query(f"{_WIDE} select d \"statDate\", sensor_id \"linkID\", {', '.join(f'h{h} hour{h:02d}' for h in range(24))} from wide")
def s1_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.payload_rows(_landed(spark, sf_dir)).drop("seq")


@query(f"{_WIDE} select d as day, case when d like '%-05' then '03' else '00' end result_code, count(*) n_rows, false is_empty, count(*) > 5000 is_over from wide group by d union all select '2024-01-31', '00', 0, true, false")
def s1_payload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.payload_status(_landed(spark, sf_dir))


@query(f"{_WIDE} select min(d) first_date, max(d) last_date from wide")
def s2_check_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.raw_counts(spark, sf_dir)
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(F.to_date("ts")).cast("string"), F.max(F.to_date("ts")).cast("string")).first()
    return P.check_date_range(raw, *ends)


@query(f"with {I.GRID} select sensor_id, ts, value from grid")
def s3_traffic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.write_traffic(I.grid(spark, sf_dir), path := _folder(spark))
    return T.read_traffic(spark, path)


@query(f"with {I.GRID} select sensor_id, ts, value from grid")
def s3_wide_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivoted to a column for each sensor, and unpivoted."""
    T.to_wide(I.grid(spark, sf_dir)).write.parquet(path := _folder(spark))
    return T.from_wide(spark.read.parquet(path))


@query(f"with {I.GRID} select sensor_id, ts, value from grid")
def s3_wide_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In blocks of at most seven sensors, and back."""
    T.write_wide(I.grid(spark, sf_dir), path := _folder(spark), 7)
    return T.read_wide(spark, path)


@query(f"with {I.GRID} select sensor_id, ts, value is null is_missing from grid")
def s4_mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.write_mask(with_mask(I.grid(spark, sf_dir)), path := _folder(spark))
    return T.read_mask(spark, path)


@query(f"with {I.LINKS} select cast(row_number() over (order by LINK_ID) - 1 as integer) idx, LINK_ID sensor_id from links")
def s5_sensor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.write_ids(I.sensors(spark, sf_dir), path := _folder(spark))
    return T.read_ids(spark, path)


_PLACES = f"with {I.LINKS} select LINK_ID sensor_id, round((3 * y + c) / 3, 6) latitude, round((3 * x + 2 * a) / 3, 6) longitude from links"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_locations(I.links(spark, sf_dir)).select("sensor_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(_PLACES)
def s6_locations_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    _places(spark, sf_dir).select(F.col("sensor_id").alias("id"), F.col("latitude").alias("y"), F.col("longitude").alias("x"), F.lit("other").alias("note")).write.option("header", True).csv(path := _folder(spark))
    return T.read_locations(spark, path, "id", "y", "x")


@query(_PLACES)
def s6_locations_without_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    _places(spark, sf_dir).select("sensor_id", "latitude", "longitude").write.csv(path := _folder(spark))
    return T.read_locations(spark, path)


@query(f'with {I.DISTANCES} select "from", "to", round(distance, 6) distance from distances')
def s7_distances_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.write_distances(I.distances(spark, sf_dir), path := _folder(spark))
    return T.read_distances(spark, path).withColumn("distance", F.round("distance", 6))


@query(f"with {I.ADJACENCY} select src, dst, cast(src_idx as integer) src_idx, cast(dst_idx as integer) dst_idx, round(weight, 6) weight from adjacency")
def s8_adjacency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.write_adjacency(I.adjacency(spark, sf_dir), I.sensors(spark, sf_dir), path := _folder(spark))
    return T.read_adjacency(spark, path)[0].withColumn("weight", F.round("weight", 6))


@query(f"with {I.LINKS} select LINK_ID, ROAD_NAME, LANES, ROAD_RANK, ROAD_TYPE, MAX_SPD, REST_VEH from links")
def s9_metadata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.write_metadata(link_metadata(I.links(spark, sf_dir))[0], path := _folder(spark))
    return T.read_metadata(spark, path)


@query(f"""with {I.GRID}, hours as (select ts, row_number() over (order by ts) - 1 n from (select distinct ts from grid)), cells as (select ts, count(value) n_values, sum(value) total from grid group by ts)
select 'part-' || lpad(cast(n // 200 as varchar), 5, '0') || '.csv' file, count(*) n_rows, min(ts) first_ts, max(ts) last_ts, sum(n_values) n_values, round(sum(total), 3) total from hours join cells using (ts) group by 1""")
def s10_export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide files of at most 200 rows that are found, with what they hold."""
    T.export_wide(I.grid(spark, sf_dir), path := _folder(spark), 200)
    files = spark.read.option("header", True).option("maxColumns", 10_000_000).csv(path)
    sensors = F.transform(T.array_of([c for c in files.columns if c != "ts"]), lambda v: v.cast("double"))
    values = F.filter(sensors, lambda v: v.isNotNull())
    rows = files.select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"), F.to_timestamp_ntz("ts").alias("ts"), F.size(values).alias("n"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("sum"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("n").alias("n_values"), F.round(F.sum("sum"), 3).alias("total"))


@query(f"""with {I.TRAFFIC}, {I.LINKS} select LINK_ID, F_NODE, T_NODE, LANES,
  'LINESTRING (' || cast(x as decimal(12, 1)) || ' ' || cast(y as decimal(12, 1)) || ', ' || cast(x + a as decimal(12, 1)) || ' ' || cast(y as decimal(12, 1)) || ', ' || cast(x + a as decimal(12, 1)) || ' ' || cast(y + c as decimal(12, 1)) || ')' wkt
  from links where LINK_ID in (select sensor_id from traffic)""")
def s11_road_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.links_with_traffic(I.links(spark, sf_dir), I.traffic_sensors(spark, sf_dir)).write.parquet(path := _folder(spark))
    return spark.read.parquet(path).select("LINK_ID", "F_NODE", "T_NODE", "LANES", "wkt")


#: The tables of ``s12_network_tables``, and the kinds of their columns; vertices of lines count as text.
_NETWORK = {
    "node": ("(select distinct T_NODE NODE_ID from links where left(T_NODE, 3) = '161')", {"NODE_ID": "string"}),
    "link": (
        "(select *, ' ' || cast(x as bigint) || ' ' || cast(y as bigint) || ' ' || cast(x + a as bigint) || ' ' || cast(y as bigint) || ' ' || cast(x + a as bigint) || ' ' || cast(y + c as bigint) vertices from links "
        "where left(LINK_ID, 3) = '161' or left(F_NODE, 3) = '161' or left(T_NODE, 3) = '161')",
        dict.fromkeys(["LINK_ID", "F_NODE", "T_NODE", "LANES", "MAX_SPD", "ROAD_NAME", "ROAD_RANK", "ROAD_TYPE", "REST_VEH", "vertices"], "string"),
    ),
    "turn": ("(select * from turns where left(NODE_ID, 3) = '161' or left(ST_LINK, 3) = '161' or left(ED_LINK, 3) = '161')", dict.fromkeys(["NODE_ID", "ST_LINK", "ED_LINK", "TURN_TYPE", "row_no"], "string")),
}


@query(f"with {I.TURNED} {' union all '.join(f"select '{part}' part, * from ({fingerprint_sql(table, kinds)})" for part, (table, kinds) in _NETWORK.items())}")
def s12_network_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and fingerprints of the region's three tables, as read back."""
    from sensorloom.operators.roadnet import region_filter

    links = I.links(spark, sf_dir)
    nodes = region_filter(links.select(F.col("T_NODE").alias("NODE_ID")).distinct(), ["161"], "NODE_ID")
    T.write_network(nodes, region_filter(links, ["161"], "LINK_ID", "F_NODE", "T_NODE"), region_filter(I.turns(spark, sf_dir), ["161"], "NODE_ID", "ST_LINK", "ED_LINK"), path := _folder(spark))
    number = lambda v: F.concat(F.lit(" "), v.cast("long").cast("string"))
    vertices = F.array_join(F.transform("geometry", lambda p: F.concat(number(p["x"]), number(p["y"]))), "")
    nodes, links, turns = T.read_network(spark, path)
    tables = {"node": nodes, "link": links.withColumn("vertices", vertices).drop("geometry"), "turn": turns}
    return functools.reduce(DataFrame.union, [fingerprint(t).select(F.lit(n).alias("part"), "n_rows", "digest") for n, t in tables.items()])


@query(f"with {I.LINKS} select LINK_ID, 'POINT (' || cast((3 * x + 2 * a) / 3 as decimal(20, 3)) || ' ' || cast((3 * y + c) / 3 as decimal(20, 3)) || ')' wkt from links")
def s13_sensor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = link_locations(I.links(spark, sf_dir)).select("sensor_id", *[F.col(c).cast("decimal(20,3)").alias(c) for c in ("latitude", "longitude")])
    T.sensor_points(places).write.parquet(path := _folder(spark))
    return spark.read.parquet(path)
