"""Queries of the road network and graph operators."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import graphops as M
from sensorloom.operators import roadnet as R
from sensorloom.operators.subset import make_graph
from sensorloom.plans.components import connected_components
from sensorloom.plans.fingerprint import fingerprint, fingerprint_sql
from sensorloom.queries import inputs as I
from sensorloom.queries.catalog import query

_CODES = ["161", "162", "163"]
_IN = "('161', '162', '163')"


@query(f"with {I.LINKS} select LINK_ID, F_NODE, T_NODE from links where left(LINK_ID, 3) in {_IN} or left(F_NODE, 3) in {_IN} or left(T_NODE, 3) in {_IN}")
def g1_region_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_filter(I.links(spark, sf_dir), _CODES, "LINK_ID", "F_NODE", "T_NODE").select("LINK_ID", "F_NODE", "T_NODE")


@query(f"with {I.TURNED} select NODE_ID, ST_LINK, ED_LINK, TURN_TYPE, row_no from turns where left(NODE_ID, 3) in {_IN} or left(ST_LINK, 3) in {_IN} or left(ED_LINK, 3) in {_IN}")
def g1_region_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_filter(I.turns(spark, sf_dir), _CODES, "NODE_ID", "ST_LINK", "ED_LINK")


_LON, _LAT = "cast(126.4 + x / 1e5 as decimal(12, 6))", "cast(37.3 + y / 1e5 as decimal(12, 6))"


@query(f"with {I.LINKS} select distinct F_NODE, cast({_LON} as double) lon, cast({_LAT} as double) lat, 'POINT (' || {_LON} || ' ' || {_LAT} || ')' wkt from links")
def g2_distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct start nodes with the point where their links begin."""
    at = F.col("geometry")[0]
    p = I.links(spark, sf_dir).select("F_NODE", (126.4 + at["x"] / 1e5).cast("decimal(12,6)").alias("lon"), (37.3 + at["y"] / 1e5).cast("decimal(12,6)").alias("lat"))
    return R.distinct_points(p, "lon", "lat").withColumns({"lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")})


@query(f"with {I.LINKS} select LINK_ID, round(len, 6) length_m from links")
def g3_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.links(spark, sf_dir).select("LINK_ID", F.round(R.line_length("geometry"), 6).alias("length_m"))


@query(f"with {I.EDGES} select src, dst, intersection_id, round(length, 6) as length from edges")
def g4_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.edges(spark, sf_dir).withColumn("length", F.round("length", 6))


@query(f"with {I.TURNED} select src, dst, intersection_id, round(length, 6) as length from turned")
def g5_turn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.turned_edges(spark, sf_dir).withColumn("length", F.round("length", 6))


@query(f'with {I.DISTANCES} select "from", "to", round(distance, 6) distance from distances')
def g6_bounded_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bounded_distances(I.road_graph(spark, sf_dir), I.sensors(spark, sf_dir), I.LIMIT, I.links(spark, sf_dir))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"with {I.ADJACENCY} select src, dst, cast(src_idx as integer) src_idx, cast(dst_idx as integer) dst_idx, round(weight, 6) weight from adjacency")
def g7_gaussian_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.adjacency(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def _in_degrees(links: DataFrame) -> DataFrame:
    moved = F.transform("geometry", lambda p: F.struct((126.4 + p["x"] / 1e5).alias("x"), (37.3 + p["y"] / 1e5).alias("y")))
    return links.withColumn("geometry", moved)


@query(f"with {I.LINKS} select LINK_ID sensor_id, round(37.3 + (3 * y + c) / 3e5, 6) latitude, round(126.4 + (3 * x + 2 * a) / 3e5, 6) longitude from links")
def g8_link_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.link_locations(_in_degrees(I.links(spark, sf_dir)))
    return found.select("sensor_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(f"with {I.TRAFFIC}, {I.LINKS} select LINK_ID, ROAD_NAME, LANES, ROAD_RANK, ROAD_TYPE, MAX_SPD, REST_VEH from links where LINK_ID in (select sensor_id from traffic)")
def g9_link_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.link_metadata(I.links(spark, sf_dir), I.traffic_sensors(spark, sf_dir))[0]


@query(f"""with {I.DISTANCES}, loc as (
  select LINK_ID id, 6378137.0 * radians(126.4 + (3 * x + 2 * a) / 3e5) mx, 6378137.0 * ln(tan(pi() / 4 + radians(37.3 + (3 * y + c) / 3e5) / 2)) my from links where left(LINK_ID, 3) <> '161')
select "from", "to", round(distance, 6) distance, round(p.mx, 3) x1, round(p.my, 3) y1, round(q.mx, 3) x2, round(q.my, 3) y2
from distances join loc p on p.id = "from" join loc q on q.id = "to\"""")
def g10_distance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the pairs whose both ends have a location."""
    places = R.link_locations(_in_degrees(I.links(spark, sf_dir))).where(~F.col("sensor_id").startswith("161"))
    lines = R.distance_lines(I.distances(spark, sf_dir), places)[0]
    return lines.select("from", "to", F.round("distance", 6).alias("distance"), *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f'with {I.DISTANCES} select "from", "to", round(distance, 6) distance from distances where left("from", 3) = \'161\' or left("to", 3) = \'161\'')
def g10_unplaced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which an end has no location."""
    places = R.link_locations(_in_degrees(I.links(spark, sf_dir))).where(~F.col("sensor_id").startswith("161"))
    return R.distance_lines(I.distances(spark, sf_dir), places)[1].withColumn("distance", F.round("distance", 6))


@query(f"""with {I.ADJACENCY},
und as (select src_idx a, dst_idx b from adjacency where weight > 0 union select dst_idx, src_idx from adjacency where weight > 0),
reach as (select idx a, idx b from sensors union select r.a, u.b from reach r join und u on u.a = r.b),
comp as (select a idx, min(b) component from reach group by a),
best as (select component from comp group by component order by count(*) desc, component limit 2)
select sensor_id, cast(component as integer) component from comp join sensors using (idx) where component in (select component from best)""")
def g11_largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.sensors(spark, sf_dir)
    return R.largest_components(I.adjacency(spark, sf_dir), s, s.select("sensor_id"), 2)


#: The tables of ``g12_graph_tables``, and the kinds of their columns.
_PARTS = {
    "sensors": ("ids", {"idx": "int", "sensor_id": "string"}),
    "metadata": ("links where LINK_ID in (select sensor_id from ids)", dict.fromkeys(["LINK_ID", "ROAD_NAME", "LANES", "ROAD_RANK", "ROAD_TYPE", "MAX_SPD", "REST_VEH"], "string")),
    "locations": ("places", {"sensor_id": "string", "latitude": "double", "longitude": "double"}),
    "distances": ("own", {'"from"': "string", '"to"': "string", "distance": "double"}),
    "adjacency": ("adj", {"src": "string", "dst": "string", "src_idx": "int", "dst_idx": "int", "weight": "double"}),
}


@query(f"""with {I.DISTANCES}, {I.TRAFFIC}, ids as (
  select cast(row_number() over (order by sensor_id) - 1 as integer) idx, sensor_id from (select distinct sensor_id from traffic where sensor_id in (select LINK_ID from links))),
places as (select LINK_ID sensor_id, 37.3 + (3 * y + c) / 3e5 latitude, 126.4 + (3 * x + 2 * a) / 3e5 longitude from links where LINK_ID in (select sensor_id from ids)),
own as (select * from distances where "from" in (select sensor_id from ids) and "to" in (select sensor_id from ids)),
adj as (
  select "from" src, "to" dst, p.idx src_idx, q.idx dst_idx, exp(-(distance / s) * (distance / s)) weight
  from own, (select stddev_pop(distance) s from own), ids p, ids q where p.sensor_id = "from" and q.sensor_id = "to" and "from" <> "to" and exp(-(distance / s) * (distance / s)) >= 0.1
  union all select sensor_id, sensor_id, idx, idx, 1.0 from ids)
{" union all ".join(f"select '{part}' part, * from ({fingerprint_sql(table, kinds)})" for part, (table, kinds) in _PARTS.items())}""")
def g12_graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and fingerprints of the tables made for the traffic sensors."""
    parts = make_graph(I.traffic_sensors(spark, sf_dir), _in_degrees(I.links(spark, sf_dir)), I.road_graph(spark, sf_dir), I.LIMIT)
    return functools.reduce(DataFrame.union, [fingerprint(table).select(F.lit(name).alias("part"), "n_rows", "digest") for name, table in parts.items()])


@query(f'with {I.DISTANCES} select "from" sensor_id from distances union select "to" from distances')
def g17_mentioned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mentioned_ids(I.distances(spark, sf_dir))


_SENSORS = I.ADJACENCY
_COO = "select cast(i as integer) src_idx, cast(j as integer) dst_idx, round(sum(w), 6) weight from out group by i, j"


def _coo(matrix: DataFrame) -> DataFrame:
    return matrix.select("src_idx", "dst_idx", F.round("weight", 6).alias("weight"))


def _shift_sql(kind: str) -> str:
    side, norm, form = kind.split("_")
    base = "select src_idx i, dst_idx j, weight w from adjacency" + (" union all select idx, idx, 1.0 from sensors" if norm == "renorm" else "")
    w = "w * r.d ** -0.5 * q.d ** -0.5" if side == "sym" else "w / r.d"
    out = f"select i, j, {'-1 * ' if form == 'lap' else ''}{w} w from a0 join deg r on r.k = i join deg q on q.k = j" + (" union all select idx, idx, 1.0 from sensors" if form == "lap" else "")
    return f"with {_SENSORS}, a1 as ({base}), a0 as (select i, j, sum(w) w from a1 group by 1, 2), deg as (select i k, sum(w) d from a0 group by 1), out as ({out}) {_COO}"


for _kind in [f"{s}_{n}_{f}" for s in ("sym", "rw") for n in ("norm", "renorm") for f in ("adj", "lap")]:

    def _shift(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return _coo(M.shift_operator(I.adjacency(spark, sf_dir), I.sensors(spark, sf_dir), kind, False))

    _shift.__name__, _shift.__doc__ = f"g13_{_kind}", f"The graph shift operator {_kind}."
    query(_shift_sql(_kind))(_shift)


@query(f"""with {_SENSORS}, a2 as (select src_idx i, dst_idx j, weight w from adjacency union all select dst_idx, src_idx, weight from adjacency),
a0 as (select i, j, max(w) w from a2 group by 1, 2), deg as (select i k, sum(w) d from a0 group by 1),
out as (select i, j, w * r.d ** -0.5 * q.d ** -0.5 w from a0 join deg r on r.k = i join deg q on q.k = j) {_COO}""")
def g13_symmetric_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coo(M.shift_operator(I.adjacency(spark, sf_dir), I.sensors(spark, sf_dir), "sym_norm_adj", True))


def _norm_sql(matrix: str, squarings: int = 18) -> str:
    """``norm(v)``: the largest singular value of ``matrix(i, j, w)``, by squaring its Gram matrix until one vector is left."""
    steps = "".join(
        f"q{k + 1} as materialized (select a.i, b.j, sum(a.w * b.w) / (select sum(w * w) from q{k}) w from q{k} a join q{k} b on a.j = b.i group by 1, 2 having abs(sum(a.w * b.w)) > 1e-200), "
        for k in range(squarings)
    )
    return f"""q0 as materialized (select a.j i, b.j j, sum(a.w * b.w) w from {matrix} a join {matrix} b on a.i = b.i group by 1, 2), {steps}
norm as materialized (select sqrt((select sum(a.w * b.w) from q0 a join q{squarings} b on a.i = b.i and a.j = b.j) / (select sum(w) from q{squarings} where i = j)) v)"""


_LAP = "select src_idx i, dst_idx j, weight w from adjacency"


@query(f"""with {_SENSORS}, a0 as ({_LAP}), deg as (select i k, sum(w) d from a0 group by 1),
op as materialized (select i, j, sum(w) w from (select i, j, -w * r.d ** -0.5 * q.d ** -0.5 w from a0 join deg r on r.k = i join deg q on q.k = j union all select idx, idx, 1.0 from sensors) group by 1, 2),
{_norm_sql("op")}, out as (select i, j, w * case when v >= 2 then 1 else 2 / v end w from op, norm union all select idx, idx, -1.0 from sensors) {_COO}""")
def g14_chebyshev(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.sensors(spark, sf_dir)
    return _coo(M.chebyshev_rescaled(M.shift_operator(I.adjacency(spark, sf_dir), s, "sym_norm_lap", False), s))


for _reverse in (False, True):

    def _walk(spark: SparkSession, sf_dir: str, reverse: bool = _reverse) -> DataFrame:
        return _coo(M.random_walk(I.adjacency(spark, sf_dir), reverse))

    _walk.__name__, _walk.__doc__ = "g15_reverse_walk" if _reverse else "g15_random_walk", "Transition probabilities of the walk."
    _i, _j = ("dst_idx", "src_idx") if _reverse else ("src_idx", "dst_idx")
    query(f"with {_SENSORS}, a0 as (select {_i} i, {_j} j, weight w from adjacency), deg as (select i k, sum(w) d from a0 group by 1), out as (select i, j, w / d w from a0 join deg on k = i) {_COO}")(_walk)

_LAPLACE = "deg as (select i k, sum(w) d from a0 group by 1), lap as (select j i, i j, -w * r.d ** -0.5 * q.d ** -0.5 w from a0 join deg r on r.k = i join deg q on q.k = j union all select idx, idx, 1.0 from sensors)"


@query(f"with {_SENSORS}, a0 as (select src_idx i, dst_idx j, weight w from adjacency), {_LAPLACE}, out as (from lap) {_COO}")
def g16_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coo(M.normalized_laplacian(I.adjacency(spark, sf_dir), I.sensors(spark, sf_dir)))


@query(f"""with {_SENSORS}, a2 as (select src_idx i, dst_idx j, weight w from adjacency union all select dst_idx, src_idx, weight from adjacency),
a0 as (select i, j, max(w) w from a2 group by 1, 2), {_LAPLACE}, out as (select i, j, 2 / 1.5 * w w from lap union all select idx, idx, -1.0 from sensors) {_COO}""")
def g16_scaled_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coo(M.scaled_laplacian(I.adjacency(spark, sf_dir), I.sensors(spark, sf_dir), 1.5))


@query(f"""with {_SENSORS}, a2 as (select src_idx i, dst_idx j, weight w from adjacency union all select dst_idx, src_idx, weight from adjacency),
a0 as (select i, j, max(w) w from a2 group by 1, 2), {_LAPLACE}, op as materialized (select i, j, sum(w) w from lap group by 1, 2),
{_norm_sql("op")}, out as (select i, j, 2 / v * w w from op, norm union all select idx, idx, -1.0 from sensors) {_COO}""")
def g16_largest_eigenvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coo(M.scaled_laplacian(I.adjacency(spark, sf_dir), I.sensors(spark, sf_dir), None))


@query(f"""with {I.ADJACENCY}, und as (select src_idx a, dst_idx b from adjacency union select dst_idx, src_idx from adjacency),
reach as (select idx a, idx b from sensors union select r.a, u.b from reach r join und u on u.a = r.b)
select cast(a as integer) node, cast(min(b) as integer) component from reach group by a""")
def g11_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(I.adjacency(spark, sf_dir).select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")))
