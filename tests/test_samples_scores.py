import datetime as dt

import pytest
from test_grid import T0, frame, values

from sensorloom.operators import samples as S
from sensorloom.operators import scores as E
from sensorloom.operators.grid import with_mask


def test_sensor_windows(spark):
    w = S.sensor_windows(with_mask(frame(spark, a=[1, 2, 3, 4, None, 6, 7, 8, 9])), 2)
    assert [(r["x"], r["y"], r["y_missing"]) for r in w.orderBy("ts").collect()] == [([1.0, 2.0], 3.0, False), ([2.0, 3.0], 4.0, False), ([6.0, 7.0], 8.0, False), ([7.0, 8.0], 9.0, False)]
    with pytest.raises(ValueError):
        S.sensor_windows(with_mask(frame(spark, a=[1, 2])), 2)


def test_network_windows(spark):
    t = with_mask(frame(spark, a=[1, 2, 3, 4, 5, 6], b=[1, None, 3, 4, 5, 6]))
    assert sorted({r["start"] for r in S.network_windows(t, 2, 1).collect()}) == [2, 3]
    with pytest.raises(ValueError):
        S.network_windows(t, 5, 1)
    # With two steps to the target, a NULL in the step between doesn't matter.
    gap = with_mask(frame(spark, a=[1, 2, None, 4, 5, 6]))
    assert sorted({(r["start"], tuple(r["x"]), tuple(r["y"])) for r in S.single_step_windows(gap, 2, 2).collect()}) == [(0, (1.0, 2.0), (4.0,))]
    assert S.all_windows(gap, 2, 2).count() == 3


def test_scaler(spark):
    t = frame(spark, a=[9, None, 2, 3, 4, None, 0])
    assert tuple(S.fit_scaler(t).first()) == (0.0, 9.0)
    assert tuple(S.fit_scaler(t, "strict", 2).first()) == (2.0, 4.0)
    assert tuple(S.fit_scaler(t, "none").first()) == (0.0, 1.0)
    flat = frame(spark, a=[5, 5, None])
    assert values(S.scale(flat, S.fit_scaler(flat)))["a"] == [0.0, 0.0, None]
    with pytest.raises(ValueError):
        S.fit_scaler(frame(spark, a=[None]))


def test_scores(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 0.0, False), ("a", 3, 2.0, 1.0, False), ("a", 3, 5.0, 1.0, True)], "sensor_id string, horizon int, y_true double, y_pred double, is_missing boolean")
    seen = E.observed_only(p).first()
    assert (seen["mae"], round(seen["smape"], 4), seen["wmape"]) == (0.5, 66.6667, 0.5)
    assert E.score(p.where("y_true = 0")).first()["smape"] == 0.0
    with pytest.warns(UserWarning):
        assert E.observed_only(p.where("is_missing")).count() == 0
    assert [tuple(r) for r in E.at_horizons(p).collect()] == [(3, 2.5)]
    assert tuple(E.cell_shares(p).first())[:3] == (3, 2, 1)


def test_calendar(spark):
    r = frame(spark, a=[1, 1]).select(S.time_of_day().alias("t"), S.day_of_week().alias("d"), S.day_of_week(one_hot=True).alias("o")).orderBy("t").collect()[1]
    assert (round(r["t"], 6), r["d"], r["o"]) == (0.041667, 0, [1.0] + [0.0] * 6)


def test_windows_over_pieces_of_a_series_equal_single_slices(spark):
    """Series longer than several pieces; a sensor without some rows gets only windows that are whole."""
    import random

    rng = random.Random(1)
    hours = 600
    series = {f"s{k}": [None if rng.random() < 0.02 else float(rng.randrange(100)) for _ in range(hours)] for k in range(2)}
    rows = [(s, T0 + dt.timedelta(hours=t), v, v is None) for s, vs in series.items() for t, v in enumerate(vs) if not (s == "s1" and t in (170, 171))]
    table = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, value double, is_missing boolean")
    for n_in, n_out in ((24, 1), (3, 2), (100, 20)):
        got = {(r["sensor_id"], r["start"]): (r["x"], r["y"], r["y_missing"]) for r in S.all_windows(table, n_in, n_out).collect()}
        want = {}
        for s, vs in series.items():
            for t in range(hours - n_in - n_out + 1):
                if s == "s0" or not {170, 171} & set(range(t, t + n_in + n_out)):
                    y = vs[t + n_in : t + n_in + n_out]
                    want[s, t] = (vs[t : t + n_in], y, [v is None for v in y])
        assert got == want
