"""The road graph: links as nodes, allowed movements as edges, bounded distances, adjacency, locations."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorloom.plans.components import connected_components
from sensorloom.plans.scratch import dropped, written, written_by

#: Turn codes that allow and that forbid a movement.
ALLOWED, FORBIDDEN = ("001", "011", "012"), ("002", "003", "101", "102", "103")
_EARTH = 6378137.0

#: So many edges, targets or locations at most are sent whole to every task: some 30 MB there, whatever the tables' size was.
FEW = 2_000_000
#: Sources of a task, and pairs of a source and a node that it has at once.
_SOURCES, _PAIRS = 256, 1_000_000


def region_filter(table: DataFrame, codes: list[str], *id_columns: str) -> DataFrame:
    """Rows with any id whose first three characters are among ``codes``."""
    hit = F.lit(False)
    for c in id_columns:
        hit = hit | F.coalesce(F.substring(c, 1, 3).isin(codes), F.lit(False))
    return table.where(hit)


def distinct_points(table: DataFrame, lon: str, lat: str) -> DataFrame:
    """Distinct rows with their point as WKT."""
    return table.dropDuplicates().withColumn("wkt", wkt_point(F.col(lon), F.col(lat)))


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def line_length(geometry: str | Column) -> Column:
    """Planar length of an array of (x, y) vertices, in the layer's unit; 0 for fewer than two."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    pieces = F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(pieces, F.lit(0.0), lambda total, d: total + d)


def link_edges(links: DataFrame) -> DataFrame:
    """``src, dst, intersection_id, length``: from each link to those that start where it ends, without U-turns."""
    if not links.groupBy("LINK_ID").count().where("count > 1").isEmpty():
        raise ValueError("LINK_ID is not unique")
    size = line_length("geometry")
    start = links.select(F.col("LINK_ID").alias("src"), F.col("F_NODE").alias("_from"), F.col("T_NODE").alias("intersection_id"), size.alias("_a"))
    end = links.select(F.col("LINK_ID").alias("dst"), F.col("F_NODE").alias("intersection_id"), F.col("T_NODE").alias("_to"), size.alias("_b"))
    return start.join(end, "intersection_id").where(F.col("_from") != F.col("_to")).select("src", "dst", "intersection_id", ((F.col("_a") + F.col("_b")) / 2).alias("length"))


def apply_turns(edges: DataFrame, turns: DataFrame, links: DataFrame) -> DataFrame:
    """Edges after the turn rules: of the rules of a movement the last with an effect, by ``row_no``, decides.

    Rules that add need both links; the movement's length is then the mean of theirs.
    """
    ids = links.select("LINK_ID", line_length("geometry").alias("_len"))
    rules = turns.where(F.col("TURN_TYPE").isin(*ALLOWED, *FORBIDDEN)).select(F.col("ST_LINK").alias("src"), F.col("ED_LINK").alias("dst"), "NODE_ID", "row_no", F.col("TURN_TYPE").isin(*ALLOWED).alias("adds"))
    rules = rules.join(ids.select(F.col("LINK_ID").alias("src"), F.col("_len").alias("_a")), "src", "left").join(ids.select(F.col("LINK_ID").alias("dst"), F.col("_len").alias("_b")), "dst", "left")
    rules = rules.where(~F.col("adds") | F.col("_a").isNotNull() & F.col("_b").isNotNull())
    last = rules.groupBy("src", "dst").agg(F.max_by(F.struct("adds", "NODE_ID", "_a", "_b"), "row_no").alias("rule"))
    added = last.where("rule.adds").select("src", "dst", F.col("rule.NODE_ID").alias("intersection_id"), ((F.col("rule._a") + F.col("rule._b")) / 2).alias("length"))
    return edges.join(last, ["src", "dst"], "left_anti").unionByName(added)


def _reached(first: np.ndarray, to: np.ndarray, length: np.ndarray, sources: np.ndarray, limit: float, max_rounds: int) -> np.ndarray:
    """Distances of all nodes from each of ``sources``, infinite beyond ``limit``; the edges of node k are those from ``first[k]`` to ``first[k + 1]``.

    Settled by ranges of a quarter of the limit: as long as pairs in the lowest range improve, those are led on, of all sources at once.
    """
    nodes, width = len(first) - 1, limit / 4 or 1.0
    best = np.full(len(sources) * nodes, np.inf)
    at = np.empty(len(best), np.int64)
    fresh = np.arange(len(sources)) * nodes + sources
    best[fresh] = 0.0
    high = width
    for _ in range(max_rounds):
        near = best[fresh] < high
        now, fresh = fresh[near], fresh[~near]
        if not now.size:
            if not fresh.size:
                return best.reshape(len(sources), nodes)
            high = (best[fresh].min() // width + 1) * width
            continue
        node = now % nodes
        count = first[node + 1] - first[node]
        ends = np.cumsum(count)
        edge = np.arange(ends[-1]) + np.repeat(first[node] - ends + count, count)
        pair, distance = np.repeat(now - node, count) + to[edge], np.repeat(best[now], count) + length[edge]
        nearer = (distance <= limit) & (distance < best[pair])
        pair, distance = pair[nearer], distance[nearer]
        np.minimum.at(best, pair, distance)
        fresh = np.concatenate([fresh, pair])
        at[fresh] = np.arange(fresh.size)
        fresh = fresh[at[fresh] == np.arange(fresh.size)]  # each pair once
    raise RuntimeError(f"paths still improve after {max_rounds} rounds")


def _distances_in_tasks(steps: DataFrame, targets: DataFrame, limit: float, max_rounds: int) -> DataFrame:
    """``bounded_distances`` of a graph that every task holds: tasks take sources, a block of ``_PAIRS`` at once, and keep nothing of those before."""
    kind = steps.schema["src"].dataType.simpleString()
    targets = targets.select(F.col("sensor_id").cast(kind)).where("sensor_id is not null").distinct()
    edges, ids = steps.where(F.col("length") <= limit).toArrow(), targets.toArrow()["sensor_id"]
    names = pc.unique(pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks, *ids.chunks], type=ids.type))
    names = names.take(pc.sort_indices(names))
    number = lambda column: pc.index_in(column, names).to_numpy().astype(np.int64)
    src = number(edges["src"])
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(len(names) + 1))
    ends = np.zeros(len(names), bool)
    ends[number(ids)] = True
    graph = steps.sparkSession.sparkContext.broadcast((first, number(edges["dst"])[order], edges["length"].to_numpy()[order], names, ends))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, to, length, names, ends = graph.value
        size = max(1, _PAIRS // max(1, len(names)))
        for batch in batches:
            sources = pc.index_in(batch.column(0), names).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(sources), size):
                best = _reached(first, to, length, sources[k : k + size], limit, max_rounds)
                row, node = np.nonzero(np.isfinite(best) & ends)
                for c in range(0, len(row), 200_000):
                    r, n = row[c : c + 200_000], node[c : c + 200_000]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(sources[k + r])), names.take(pa.array(n)), pa.array(best[r, n])], ["from", "to", "distance"])

    return targets.repartition(-(-len(ids) // _SOURCES) or 1).mapInArrow(blocks, f"from {kind}, to {kind}, distance double")


def bounded_distances(edges: DataFrame, targets: DataFrame, limit: float, links: DataFrame | None = None, width: float | None = None, doublings: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``from, to, distance``: shortest paths of at most ``limit`` over all links between ``targets(sensor_id)``, each to itself at 0; no pair repeats.

    With ``links`` given, a target that is no link is an error. A graph of at most ``FEW`` edges and targets goes to the tasks, which deal with their
    own sources: no pair is shuffled or written, and whoever reads the result twice has it made twice. Larger graphs, and any for which ``width`` or
    ``doublings`` is given, are joined: edges first to steps of up to ``2 ** doublings`` edges (2 if None), which takes that many
    times fewer rounds. Distances settle by ranges of a ``width``, half the limit if none is given (delta-stepping): as long as pairs in the
    lowest open range improve, those are led on by steps of at most the width; then the range is settled, never written or summed again, and its pairs are led on
    by longer steps once. All pairs are kept bucketed by source and node, so each round deals out only what it has reached. A round beyond
    ``max_rounds`` raises.
    """
    if links is not None:
        unknown = targets.join(links.select(F.col("LINK_ID").alias("sensor_id")), "sensor_id", "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"targets that are no links: {', '.join(r['sensor_id'] for r in unknown)}")
    steps = edges.groupBy("src", "dst").agg(F.min("length").alias("length"))
    if width is None and doublings is None:
        steps = written(steps.where(F.col("src").isNotNull() & F.col("dst").isNotNull()))
        if steps.count() <= FEW and targets.count() <= FEW:
            found = _distances_in_tasks(steps, targets, limit, max_rounds)
            dropped(steps)
            return found
    doublings = 2 if doublings is None else doublings
    for _ in range(doublings):
        former = steps = written(steps)
        ahead = steps.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("length").alias("_more"))
        longer = steps.join(ahead, "dst").select("src", F.col("_to").alias("dst"), (F.col("length") + F.col("_more")).alias("length")).where((F.col("length") <= limit) & (F.col("src") != F.col("dst")))
        steps = written(steps.union(longer).groupBy("src", "dst").agg(F.min("length").alias("length")))
        dropped(former)
    steps = steps if doublings else written(steps)
    width = width or limit / 2 or 1.0
    short, long = steps.where(F.col("length") <= width), steps.where(F.col("length") > width)
    any_long = not long.isEmpty()

    def reached(pairs: DataFrame, by: DataFrame) -> DataFrame:
        ahead = pairs.join(by, pairs["node"] == by["src"]).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("length")).alias("distance"))
        return ahead.where(F.col("distance") <= limit).groupBy("source", "node").agg(F.min("distance").alias("_new"))

    def merged(new: DataFrame, stay_fresh: Column) -> tuple[DataFrame, float | None]:
        """The open pairs after a round, and the least distance of those not led on yet."""
        for done in settled:  # nearer already
            new = new.join(done.select("source", "node"), ["source", "node"], "left_anti")
        improved = F.coalesce(F.col("_new") < F.col("distance"), F.col("_new").isNotNull())
        both = open_.join(new, ["source", "node"], "full")
        pairs = both.select("source", "node", F.least("distance", "_new").alias("distance"), (improved | stay_fresh).alias("fresh"))
        least = Observation()
        table = written_by(pairs.observe(least, F.min(F.when(F.col("fresh"), F.col("distance"))).alias("nearest")), "source", "node", dealt=True)
        return table, least.get["nearest"]

    start = targets.select(F.col("sensor_id").alias("source"), F.col("sensor_id").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")).distinct()
    tables = [written_by(start, "source", "node")]
    open_, settled, high, nearest = tables[0], [], width, 0.0
    for _ in range(max_rounds):
        if nearest is not None and nearest < high:
            now = F.col("fresh") & (F.col("distance") < high)
            later = F.coalesce(F.col("fresh") & (F.col("distance") >= high), F.lit(False))
            table, nearest = merged(reached(open_.where(now), short), later)
            tables.append(table)
            # A former table of this range has nothing that the new one hasn't.
            if len(tables) > 1 and tables[-2] is open_:
                dropped(tables.pop(-2))
            open_ = tables[-1]
            continue
        range_ = open_.where(F.col("distance") < high)
        open_ = open_.where(F.col("distance") >= high)
        settled.append(range_)
        if any_long:
            open_, nearest = merged(reached(range_, long), F.coalesce("fresh", F.lit(False)))
            tables.append(open_)
        if nearest is None:
            settled.append(open_)
            break
        high = (nearest // width + 1) * width
    else:
        raise RuntimeError(f"paths still improve after {max_rounds} rounds")
    best = functools.reduce(DataFrame.union, [t.select("source", "node", "distance") for t in settled])
    ends = targets.select(F.col("sensor_id").alias("node")).distinct()
    return best.join(ends, "node", "left_semi").select(F.col("source").alias("from"), F.col("node").alias("to"), "distance")


def gaussian_adjacency(distances: DataFrame, sensors: DataFrame, least: float = 0.1, unique: bool = False) -> DataFrame:
    """``src, dst, src_idx, dst_idx, weight``: exp(-(d / deviation)^2) where at least ``least``; directed, diagonal 1, absent is 0.

    The deviation is over all finite distances of the table; pairs with an unknown id are skipped. Of repeated
    pairs that with the greatest ``seq`` counts, if the table has such a column; ``unique`` says that none repeats, so that
    only near pairs are shuffled.
    """
    finite = distances.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") != float("inf")))
    spread = finite.agg(F.stddev_pop("distance")).scalar()
    pairs = distances if unique else distances.groupBy("from", "to").agg((F.max_by("distance", "seq") if "seq" in distances.columns else F.max("distance")).alias("distance"))
    one = sensors.select(F.col("sensor_id").alias("from"), F.col("idx").alias("src_idx"))
    two = sensors.select(F.col("sensor_id").alias("to"), F.col("idx").alias("dst_idx"))
    ratio = F.try_divide(F.col("distance"), spread)
    near = pairs.where(F.col("from") != F.col("to")).withColumn("weight", F.exp(-ratio * ratio)).where(F.col("weight") >= least)
    weighted = near.join(one, "from").join(two, "to")
    diagonal = sensors.select(F.col("sensor_id").alias("src"), F.col("sensor_id").alias("dst"), F.col("idx").alias("src_idx"), F.col("idx").alias("dst_idx"), F.lit(1.0).alias("weight"))
    return weighted.select(F.col("from").alias("src"), F.col("to").alias("dst"), "src_idx", "dst_idx", "weight").union(diagonal)


def link_locations(links: DataFrame) -> DataFrame:
    """``sensor_id, latitude, longitude``: the plain mean of a link's vertices, given in degrees."""
    mean = lambda axis: F.aggregate(F.transform("geometry", lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v) / F.size("geometry")
    return links.where(F.size("geometry") > 0).select(F.col("LINK_ID").alias("sensor_id"), mean("y").alias("latitude"), mean("x").alias("longitude"))


#: The metadata columns.
METADATA = ["LINK_ID", "ROAD_NAME", "LANES", "ROAD_RANK", "ROAD_TYPE", "MAX_SPD", "REST_VEH"]


def link_metadata(links: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Metadata of the links, or of the requested ones and the requested ids without any."""
    table = links.select(*METADATA)
    if ids is None:
        return table, None
    wanted = ids.select(F.col("sensor_id").alias("LINK_ID"))
    return table.join(wanted, "LINK_ID", "left_semi"), wanted.join(table, "LINK_ID", "left_anti")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(_EARTH) * F.radians(lon), F.lit(_EARTH) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def distance_lines(distances: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A segment in web Mercator for each pair with both locations (``wkt``), and the pairs without."""
    x, y = web_mercator(F.col("longitude"), F.col("latitude"))
    at = locations.select("sensor_id", x.alias("x"), y.alias("y"))
    if at.count() <= FEW:  # the pairs stay where they are
        at = F.broadcast(at)
    ends = distances.join(at.select(F.col("sensor_id").alias("from"), F.col("x").alias("x1"), F.col("y").alias("y1")), "from", "left")
    ends = ends.join(at.select(F.col("sensor_id").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2")), "to", "left")
    whole = F.col("x1").isNotNull() & F.col("x2").isNotNull()
    text = F.concat(F.lit("LINESTRING ("), F.col("x1").cast("string"), F.lit(" "), F.col("y1").cast("string"), F.lit(", "), F.col("x2").cast("string"), F.lit(" "), F.col("y2").cast("string"), F.lit(")"))
    return ends.where(whole).withColumn("wkt", text), ends.where(~whole).select("from", "to", "distance")


def mentioned_ids(distances: DataFrame) -> DataFrame:
    """Ids at either end of the distances."""
    return distances.select(F.explode(F.array("from", "to")).alias("sensor_id")).distinct()


def largest_components(adjacency: DataFrame, sensors: DataFrame, current: DataFrame, count: int | None = 1) -> DataFrame:
    """``sensor_id, component`` of the ``count`` largest components among the ``current`` sensors; equal sizes by the least index.

    Sensors that the graph lacks are dropped. None or 0 keeps all, without a component.
    """
    if not count:
        return current.select("sensor_id", F.lit(None).cast("int").alias("component"))
    nodes = sensors.join(current.select("sensor_id"), "sensor_id", "left_semi").select("sensor_id", "idx")
    edges = adjacency.where("weight > 0").join(nodes.select(F.col("sensor_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("sensor_id").alias("dst")), "dst", "left_semi")
    pairs = edges.select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")).union(nodes.select(F.col("idx").alias("src"), F.col("idx").alias("dst")))
    found = connected_components(pairs)
    sizes = found.groupBy("component").count()
    first = sizes.orderBy(F.col("count").desc(), "component").limit(count)
    return found.join(first, "component", "left_semi").join(nodes, F.col("node") == F.col("idx")).select("sensor_id", F.col("component").cast("int"))


def top_neighbours(adjacency: DataFrame, n: int = 10) -> DataFrame:
    """``target, neighbour, rank``: the heaviest outgoing edges, without the sensor itself; ties by index."""
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst_idx")
    ranked = adjacency.where((F.col("weight") > 0) & (F.col("src") != F.col("dst"))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select(F.col("src").alias("target"), F.col("dst").alias("neighbour"), "rank")
