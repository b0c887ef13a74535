import pytest
from pyspark.sql import functions as F

from sensorloom.operators import graphops as M
from sensorloom.operators import roadnet as R
from sensorloom.plans.components import connected_components

LINK = "LINK_ID string, F_NODE string, T_NODE string, geometry array<struct<x:double,y:double>>"
TURN = "NODE_ID string, ST_LINK string, ED_LINK string, TURN_TYPE string, row_no long"


def links(spark):
    line = lambda n: [(0.0, 0.0), (float(n), 0.0)]
    return spark.createDataFrame([("ab", "a", "b", line(2)), ("ba", "b", "a", line(2)), ("bc", "b", "c", line(4)), ("cd", "c", "d", line(6)), ("xy", "x", "y", line(1))], LINK)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in ("src", "dst", *cols)) for r in df.collect())


def test_edges_without_u_turns(spark):
    assert pairs(R.link_edges(links(spark)), "length") == [("ab", "bc", 3.0), ("bc", "cd", 5.0)]
    with pytest.raises(ValueError):
        R.link_edges(links(spark).union(links(spark).limit(1)))


def test_last_relevant_turn_rule_decides(spark):
    rules = [
        ("b", "ab", "bc", "101", 1), ("b", "ab", "bc", "011", 2),  # removed, then added
        ("c", "bc", "cd", "001", 3), ("c", "bc", "cd", "002", 4), ("c", "bc", "cd", "777", 9),  # added, then removed; unknown codes don't count
        ("b", "ab", "ba", "012", 5),  # a U-turn that a rule allows
        ("b", "ab", "zz", "011", 6), ("y", "xy", "zz", "101", 7),  # unknown links
    ]
    got = R.apply_turns(R.link_edges(links(spark)), spark.createDataFrame(rules, TURN), links(spark))
    assert pairs(got, "length") == [("ab", "ba", 2.0), ("ab", "bc", 3.0)]


def test_bounded_distances(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 1.0), ("d", "a", 1.0)], "src string, dst string, length double")
    targets = spark.createDataFrame([("a",), ("c",), ("d",)], "sensor_id string")
    got = {(r["from"], r["to"]): r["distance"] for r in R.bounded_distances(edges, targets, 2.5).collect()}
    assert got == {("a", "a"): 0.0, ("a", "c"): 2.0, ("c", "c"): 0.0, ("c", "d"): 1.0, ("c", "a"): 2.0, ("d", "d"): 0.0, ("d", "a"): 1.0}
    with pytest.raises(ValueError):
        R.bounded_distances(edges, targets, 2.5, links(spark))


def test_adjacency_is_directed_and_single_sensor_works(spark):
    sensors = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, sensor_id string")
    d = spark.createDataFrame([("a", "a", 0.0), ("b", "b", 0.0), ("a", "b", 1.0), ("a", "q", 1.0)], "from string, to string, distance double")
    got = {(r["src_idx"], r["dst_idx"]): round(r["weight"], 6) for r in R.gaussian_adjacency(d, sensors, 0.0).collect()}
    assert set(got) == {(0, 0), (1, 1), (0, 1)} and got[0, 0] == 1.0
    alone = R.gaussian_adjacency(d.where("to = 'a'"), sensors.where("idx = 0"))
    assert [r["weight"] for r in alone.collect()] == [1.0]


def test_component_ties_and_neighbour_ties(spark):
    sensors = spark.createDataFrame([(k, s) for k, s in enumerate("abcdef")], "idx int, sensor_id string")
    adj = spark.createDataFrame([("e", "f", 4, 5, 0.5), ("b", "a", 1, 0, 0.5), ("c", "d", 2, 3, 0.5), ("c", "c", 2, 2, 1.0), ("c", "a", 2, 0, 0.5)], "src string, dst string, src_idx int, dst_idx int, weight double").where("src <> 'c' or dst <> 'a'")
    best = R.largest_components(adj, sensors, sensors.select("sensor_id"), 1)
    assert sorted(r["sensor_id"] for r in best.collect()) == ["a", "b"]
    both = spark.createDataFrame([("c", "d", 2, 3, 0.5), ("c", "a", 2, 0, 0.5), ("c", "b", 2, 1, 0.9), ("c", "c", 2, 2, 1.0)], adj.schema)
    assert [r["neighbour"] for r in R.top_neighbours(both, 2).orderBy("rank").collect()] == ["b", "a"]


def test_components_of_chains_and_stars(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 130)]
    edges = spark.createDataFrame(chain + star + [(200, 200)], "src long, dst long")
    wanted = {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200}
    for few in (20_000, 0):
        monkeypatch.setattr("sensorloom.plans.components.FEW_EDGES", few)
        assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == wanted


def test_shift_operators_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a = np.where(rng.random((5, 5)) < 0.6, rng.random((5, 5)), 0)
    a[3] = 0
    sensors = spark.createDataFrame([(k, str(k)) for k in range(5)], "idx int, sensor_id string")
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(5) for j in range(5) if a[i, j]], "src_idx int, dst_idx int, weight double")

    def dense(df):
        out = np.zeros((5, 5))
        for r in df.collect():
            out[r["src_idx"], r["dst_idx"]] = r["weight"]
        return out

    d = a.sum(1)
    root = np.where(d > 0, np.where(d > 0, d, 1) ** -0.5, 0)
    assert np.allclose(dense(M.shift_operator(coo, sensors, "sym_norm_lap", False)), np.eye(5) - root[:, None] * a * root)
    both = np.maximum(a, a.T)  # the default makes the adjacency symmetric first
    s = np.where(both.sum(1) > 0, np.where(both.sum(1) > 0, both.sum(1), 1) ** -0.5, 0)
    assert np.allclose(dense(M.shift_operator(coo, sensors, "sym_norm_lap")), np.eye(5) - s[:, None] * both * s)
    assert np.allclose(dense(M.random_walk(coo)), np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)[:, None] * a)
    assert abs(M.spectral_norm(coo, sensors) - np.linalg.norm(a, 2)) < 1e-5
    with pytest.raises(ValueError):
        M.shift_operator(coo, sensors, "up_norm_adj")


def test_lengths_and_points(spark):
    g = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0), (3.0, 5.0)],), ([(1.0, 1.0)],), ([],)], "geometry array<struct<x:double,y:double>>")
    assert [r[0] for r in g.select(R.line_length("geometry")).collect()] == [6.0, 0.0, 0.0]
    assert R.region_filter(links(spark).withColumn("LINK_ID", F.concat(F.lit("161"), "LINK_ID")), ["161"], "LINK_ID").count() == 5


def test_distances_of_the_queries_against_dijkstra(spark):
    """All graph queries follow paths of up to 9000; their distances against one Dijkstra for each sensor."""
    import heapq

    from sensorloom.queries import inputs as I

    sf = "/root/testdata/sf0.01"
    steps, wanted = {}, {}
    for r in I.turned_edges(spark, sf).collect():
        steps.setdefault(r["src"], []).append((r["dst"], r["length"]))
    for (start,) in I.sensors(spark, sf).select("sensor_id").collect():
        heap = [(0.0, start)]
        while heap:
            d, node = heapq.heappop(heap)
            if (start, node) not in wanted:
                wanted[start, node] = d
                for to, length in steps.get(node, []):
                    if d + length <= 9000:
                        heapq.heappush(heap, (d + length, to))
    assert I.LIMIT == 9000 and max(wanted.values()) > 1500
    got = {(r["from"], r["to"]): r["distance"] for r in I.distances(spark, sf).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - d) < 1e-6 for k, d in wanted.items())


def test_spectral_norm_that_has_not_settled_raises(spark):
    from sensorloom.operators.graphops import spectral_norm

    m = spark.createDataFrame([(k, k, 2.0 + k) for k in range(8)], "src_idx int, dst_idx int, weight double")
    s = spark.createDataFrame([(str(k), k) for k in range(8)], "sensor_id string, idx int")
    with pytest.raises(RuntimeError):
        spectral_norm(m, s, steps=2)
    assert abs(spectral_norm(m, s) - 9) < 1e-6


def test_ranges_and_longer_steps_give_the_same_distances(spark):
    """Any width of the ranges, also below single edges, and any doubling; several improvements of a pair within a range."""
    import heapq
    import random

    rng = random.Random(7)
    edges = [(a, b, rng.choice([1.0, 2.0, 3.5, 9.0, 25.0])) for a in range(25) for b in rng.sample(range(25), 3)] + [(0, 1, 0.0), (0, 1, 4.0)]
    wanted = {}
    for start in (0, 3, 7, 11):
        heap = [(0.0, start)]
        while heap:
            d, node = heapq.heappop(heap)
            if (start, node) not in wanted:
                wanted[start, node] = d
                for a, b, length in edges:
                    if a == node and d + length <= 20:
                        heapq.heappush(heap, (d + length, b))
    wanted = {(str(a), str(b)): d for (a, b), d in wanted.items() if b in (0, 3, 7, 11)}
    table = spark.createDataFrame([(str(a), str(b), d) for a, b, d in edges], "src string, dst string, length double")
    targets = spark.createDataFrame([("0",), ("3",), ("7",), ("11",), ("7",)], "sensor_id string")
    for width, doublings in ((None, 2), (2.0, 0), (4.0, 1), (100.0, 0)):
        got = {(r["from"], r["to"]): r["distance"] for r in R.bounded_distances(table, targets, 20.0, width=width, doublings=doublings).collect()}
        assert got == wanted
    with pytest.raises(RuntimeError):
        R.bounded_distances(table, targets, 20.0, doublings=0, max_rounds=2)


def test_settled_and_open_pairs_are_not_shuffled(spark, monkeypatch):
    plans = []
    real = R.written_by

    def seen(df, *keys, dealt=False):
        if dealt:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *keys, dealt=dealt)

    monkeypatch.setattr(R, "written_by", seen)
    edges = spark.createDataFrame([(str(k), str(k + 1), 1.0) for k in range(12)], "src string, dst string, length double")
    R.bounded_distances(edges, spark.createDataFrame([("0",)], "sensor_id string"), 12.0, width=4.0, doublings=0)
    assert len(plans) > 8 and all(plan.count("Exchange hashpartitioning(source") == 1 and "Bucketed: true" in plan for plan in plans)


def test_largest_singular_values_of_many_graphs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    ring = np.roll(np.eye(40), 1, 1) + np.roll(np.eye(40), -1, 1)
    repeated, single = np.kron(np.eye(3), rng.random((4, 4))), np.zeros((6, 6))
    single[2, 5] = -3.0
    for a in (rng.normal(size=(30, 30)), np.eye(40) - ring / 2, repeated, np.eye(7), single, np.zeros((3, 3)), np.triu(rng.random((12, 12)))):
        sensors = spark.createDataFrame([(k, str(k)) for k in range(len(a))], "idx int, sensor_id string")
        i, j = np.nonzero(a)
        coo = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "src_idx int, dst_idx int, weight double")
        assert abs(M.spectral_norm(coo, sensors) - np.linalg.norm(a, 2)) <= 1e-8 * max(1, np.linalg.norm(a, 2))


def test_distances_in_tasks_equal_joined_ones(spark, monkeypatch):
    """Graphs that go to the tasks and those that are joined, also in blocks of few sources, with null rows and targets that no edge has."""
    import random

    rng = random.Random(3)
    edges = [(str(a), str(b), rng.choice([0.0, 0.5, 2.0, 3.5, 9.0])) for a in range(60) for b in rng.sample(range(60), 3)]
    table = spark.createDataFrame([*edges, ("1", None, 1.0), (None, "1", 1.0), ("1", "2", None), ("1", "3", float("nan")), ("5", "6", 21.0)], "src string, dst string, length double")
    targets = spark.createDataFrame([(str(k),) for k in (*range(0, 60, 2), 4, 99)], "sensor_id string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for limit in (20.0, 0.0):
        monkeypatch.setattr(R, "FEW", 2_000_000)
        here = [rows(R.bounded_distances(table, targets, limit))]
        monkeypatch.setattr(R, "_PAIRS", 130)
        monkeypatch.setattr(R, "_SOURCES", 7)
        here.append(rows(R.bounded_distances(table, targets, limit)))
        monkeypatch.setattr(R, "FEW", 100)
        assert here[0] == here[1] == rows(R.bounded_distances(table, targets, limit)) and ("99", "99", 0.0) in here[0]
    back = spark.createDataFrame([("0", "1", -1.0), ("1", "0", -1.0)], table.schema)
    monkeypatch.setattr(R, "FEW", 2)
    with pytest.raises(Exception, match="still improve after 50 rounds"):
        R.bounded_distances(back, targets.limit(1), 5.0, max_rounds=50).collect()
    assert R.bounded_distances(table.limit(0), targets.limit(0), 5.0).collect() == []


def test_pairs_stay_in_their_tasks(spark, tmp_path):
    """Neither distances nor what is made of them sorts, shuffles or writes all pairs."""
    import os

    from sensorloom.plans.scratch import scratch_folder

    edges = spark.createDataFrame([(str(k), str(k + 1), 1.0) for k in range(30)], "src string, dst string, length double")
    targets = spark.createDataFrame([(str(k), k) for k in range(31)], "sensor_id string, idx int")
    folder = scratch_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    d = R.bounded_distances(edges, targets, 9.0)
    assert set(os.listdir(folder)) == before
    places = targets.select("sensor_id", F.col("idx").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (d, *R.distance_lines(d, places.where("latitude < 20"))):
        above = plan(df).split("MapInArrow")[0]
        assert "Exchange hashpartitioning" not in above and "SortMergeJoin" not in above and df.count()
    near = lambda unique: sorted(map(tuple, R.gaussian_adjacency(d, targets, 0.3, unique).collect()))
    assert near(True) == near(False) and len(near(True)) > 31
    assert plan(R.gaussian_adjacency(d, targets, unique=True)).count("HashAggregate(keys=[from") == 0 < plan(R.gaussian_adjacency(d, targets)).count("HashAggregate(keys=[from")
