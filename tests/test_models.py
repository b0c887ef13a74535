import datetime as dt

import numpy as np
import pytest
from test_grid import SCHEMA, T0, frame, values

from sensorloom.operators import model_fills as K
from sensorloom.operators import neighbours as N
from sensorloom.operators.factorize import bgcp_fill, trmf_fill
from sensorloom.operators.fills import fallback, hour_mean
from sensorloom.queries import models as Q


def plain_nearest(x, k):
    """One row at a time."""
    out = x[:, 0].copy()
    donors = [i for i in range(len(x)) if not np.isnan(x[i, 0])]
    for i in range(len(x)):
        if np.isnan(x[i, 0]):
            far = []
            for j in donors:
                common = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if common.any():
                    far.append((np.sum((x[i, common] - x[j, common]) ** 2) * x.shape[1] / common.sum(), j))
            out[i] = np.mean([x[j, 0] for _, j in sorted(far)[:k]]) if far else np.mean([x[j, 0] for j in donors])
    return out


def test_nearest_rows_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = rng.random((60, 4))
        x[rng.random(x.shape) < 0.3] = np.nan
        assert np.allclose(K.nearest_rows(x, 3, chunk=7), plain_nearest(x, 3))


def test_pruned_search_equals_brute_force():
    """Whole numbers with many ties, with and without a column to order by, in chunks and blocks smaller than the search."""
    rng = np.random.default_rng(4)
    for k in range(30):
        x = np.round(rng.random((60, 4)) * rng.choice([2, 10, 1000]))
        x[rng.random(x.shape) < 0.3] = np.nan
        if k % 3:
            x[:, 3] = np.round(rng.random(60) * 10) if k % 3 == 1 else 5.0
        assert np.allclose(K.nearest_rows(x, 3, chunk=7, block=5), plain_nearest(x, 3), equal_nan=True)


def test_search_ends_before_all_rows_are_met(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(np.arange(2000.0), 2)[:, None] + rng.random((4000, 3)) * 0.01
    wanted = x[:, 0].copy()
    x[1::2, 0] = np.nan
    met = []
    real = np.partition
    monkeypatch.setattr(K.np, "partition", lambda far, *a, **b: met.append(far.size) or real(far, *a, **b))
    assert np.abs(K.nearest_rows(x, 1, block=64) - wanted).max() < 0.05
    assert sum(met) < 0.2 * 2000 * 2000


def low_rank(spark, hidden=0.3, seed=0):
    """Six sensors over six days, a smooth pattern of rank two, some cells hidden."""
    rng = np.random.default_rng(seed)
    hours = np.arange(144)
    day, trend = 20 + 12 * np.sin(2 * np.pi * hours / 24), 10 + 8 * np.cos(2 * np.pi * hours / 72)
    truth = {f"s{k}": (1 + k / 3) * day + (k % 3) * trend for k in range(6)}
    rows, gone = [], {}
    for s, v in truth.items():
        for t in hours:
            hide = rng.random() < hidden
            rows.append((s, T0 + dt.timedelta(hours=int(t)), None if hide else float(v[t])))
            if hide:
                gone[s, int(t)] = float(v[t])
    return spark.createDataFrame(rows, SCHEMA), gone


def error(filled, gone):
    got = values(filled)
    assert all(v is not None for vs in got.values() for v in vs)
    return np.mean([abs(got[s][t] - v) for (s, t), v in gone.items()])


@pytest.mark.parametrize("fill", [lambda t: trmf_fill(t, rank=4, rounds=12, weight_w=1, weight_x=1, weight_theta=1), lambda t: bgcp_fill(t, rank=3, burn=12, gibbs=8)])
def test_factor_models_beat_hour_means_and_repeat(spark, fill):
    table, gone = low_rank(spark)
    assert error(fill(table), gone) < error(fallback()(hour_mean()(table)), gone)
    again = values(fill(table.repartition(3)))
    first = values(fill(table))
    assert all(np.allclose(first[s], again[s]) for s in first)
    seen = values(table)
    assert all(v is None or v == first[s][k] for s, vs in seen.items() for k, v in enumerate(vs))


def adjacency(spark, ids):
    return spark.createDataFrame([(a, b, i, j, 1.0 if i == j else 0.5) for i, a in enumerate(ids) for j, b in enumerate(ids)], "src string, dst string, src_idx int, dst_idx int, weight double")


def test_neighbour_fills(spark):
    table, gone = low_rank(spark, 0.2)
    adj = adjacency(spark, [f"s{k}" for k in range(6)])
    plain = error(fallback()(hour_mean()(table)), gone)
    assert error(K.knn_fill(table, adj, 5, 3), gone) < plain
    first = values(K.mice_fill(table, adj, 5, trees=4, rounds=3))
    assert np.mean([abs(first[s][t] - v) for (s, t), v in gone.items()]) < plain
    assert values(K.mice_fill(table.repartition(5), adj, 5, trees=4, rounds=3)) == first
    assert error(K.temporal_mice_fill(table, trees=3, rounds=2), gone) < 2 * plain


def test_slices_are_of_sensors_with_gaps(spark):
    t = frame(spark, a=[1, None], b=[3, 4], c=[5, 6])
    adj = adjacency(spark, ["a", "b", "q"])
    s = N.neighbour_slices(t, adj, N.network_average(t), 2).orderBy("ts").collect()
    assert [r["target"] for r in s] == ["a", "a"] and s[0]["features"] == [1.0, 3.0, 3.0]
    assert np.isnan(s[1]["features"][0]) and s[1]["features"][1:] == [4.0, 5.0]


def test_all_null_sensor_is_left_to_the_fallback(spark):
    t = frame(spark, a=[None] * 30, b=list(range(30)))
    assert values(K.knn_fill(t, adjacency(spark, ["a", "b"]), 1, 2))["a"] == [None] * 30
    assert values(trmf_fill(t, rank=2, rounds=2))["b"] == [float(v) for v in range(30)]


def test_segments_and_back(spark):
    t = frame(spark, a=[*range(50)], b=[7] * 50)
    segments, tail = N.standardized_segments(t)
    assert segments.count() == 4 and tail.count() == 4
    back = {(r["sensor_id"], (r["ts"] - T0).total_seconds() // 3600): r["imputed"] for r in N.unscaled(segments, t).collect()}
    assert all(abs(back["a", k] - k) < 1e-9 and back["b", k] == 7 for k in range(48))
    with pytest.raises(ValueError):
        N.standardized_segments(frame(spark, a=[1, 2]))


def test_trees_grow_fully():
    """2,000 distinct values need more than the 1,024 leaves of depth 10."""
    rng = np.random.default_rng(5)
    x, y = rng.random((2000, 3)), rng.permutation(2000).astype(float)
    assert np.allclose(K.RandomTrees(2, None, rng).fit(x, y).predict(x), y)
    flat = K.RandomTrees(3, 1, rng).fit(x, y).predict(x)
    assert len(np.unique(flat)) <= 2**3
    assert np.allclose(K.RandomTrees(2, None, rng).fit(np.ones((4, 2)), np.array([1.0, 2, 3, 6])).predict(np.zeros((2, 2))), 3)


@pytest.mark.parametrize("name, fill", [("p4_knn_fill", "knn_fill"), ("p5_mice_fill", "mice_fill"), ("p6_temporal_mice_fill", "temporal_mice_fill"), ("p7_trmf_fill", "trmf_fill"), ("p8_bgcp_fill", "bgcp_fill")])
def test_registered_fills_run_at_the_operators_defaults(spark, monkeypatch, name, fill):
    calls = []
    monkeypatch.setattr(Q, "written_once", lambda spark, make, *key: make())
    monkeypatch.setattr(Q if hasattr(Q, fill) else K, fill, lambda *a, **b: calls.append((len(a), b)) or a[0])
    getattr(Q, name)(spark, "/root/testdata/sf0.001")
    assert calls == [(2 if fill in ("knn_fill", "mice_fill") else 1, {})]


def test_graph_of_the_fills_has_ten_neighbours(spark):
    found = Q._dense_adjacency(spark, "/root/testdata/sf0.01").where("src <> dst").groupBy("src").count().collect()
    assert len(found) == 20 and min(r["count"] for r in found) >= 10


def test_trees_of_two_rows_and_of_equal_rows():
    """Nodes of two rows split by any feature that tells them apart; rows that no feature tells apart stay together."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (300, 4)).astype(float)
    y = rng.random(300)
    got = K.RandomTrees(20, None, rng).fit(x, y).predict(x)
    means = {tuple(r): y[(x == r).all(1)].mean() for r in x}
    assert np.allclose(got, [means[tuple(r)] for r in x])
    pair = K.RandomTrees(400, None, rng).fit(np.array([[0.0, 5, 1], [1, 5, 2]]), np.array([0.0, 1.0]))
    assert {int(f) for f in pair.levels[0][0]} == {0, 2} and np.allclose(pair.predict(np.array([[0.0, 5, 1], [1, 5, 2]])), [0, 1])
