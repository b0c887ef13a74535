import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import grid as G

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "sensor_id string, ts timestamp_ntz, value double"


def frame(spark, **series):
    """A long table from lists of hourly values."""
    return spark.createDataFrame([(s, T0 + dt.timedelta(hours=k), None if v is None else float(v)) for s, vs in series.items() for k, v in enumerate(vs)], SCHEMA)


def values(df):
    out = {}
    for r in df.orderBy("sensor_id", "ts").collect():
        out.setdefault(r["sensor_id"], []).append(r["value"])
    return out


def test_last_row_of_an_hour_wins_even_if_null(spark):
    hours = {f"hour{h:02d}": None for h in range(24)}
    rows = [{"statDate": "2024-01-01", "linkID": "a", "seq": 1, **hours, "hour00": 5.0, "hour01": 6.0}, {"statDate": "2024-01-01", "linkID": "a", "seq": 2, **hours, "hour01": float("nan")}]
    raw = spark.createDataFrame(rows, "statDate string, linkID string, seq long, " + ", ".join(f"{h} double" for h in hours))
    got = values(G.from_hour_columns(raw))["a"]
    assert got == [None] * 24
    assert values(G.from_hour_columns(raw.where("seq = 1")))["a"][:3] == [5.0, 6.0, None]


def test_grid_spans_all_sensors_and_drops_rows_off_it(spark):
    rows = [("a", T0, 1.0), ("b", T0 + dt.timedelta(hours=3), 2.0), ("a", T0 + dt.timedelta(minutes=90), 9.0)]
    assert values(G.regular_grid(spark.createDataFrame(rows, SCHEMA))) == {"a": [1.0, None, None, None], "b": [None, None, None, 2.0]}


def test_frequency_must_be_single(spark):
    assert G.step_hours(frame(spark, a=[1, 2, 3])) == 1
    with pytest.raises(ValueError):
        G.step_hours(frame(spark, a=[1, 2, 3, 4]).where(F.hour("ts") != 1))


def test_order_check(spark):
    t = frame(spark, a=[1, 2])
    assert G.check_order(t).count() == 2
    with pytest.raises(ValueError):
        G.check_order(t.union(t.limit(1)))


def test_selection_reports_unknown_sensors(spark):
    ids = spark.createDataFrame([(0, "b"), (1, "x")], "idx int, sensor_id string")
    known, unknown = G.select_sensors(frame(spark, a=[1], b=[2]), ids)
    assert [tuple(r) for r in known.select("sensor_id", "idx", "value").collect()] == [("b", 0, 2.0)]
    assert [r["sensor_id"] for r in unknown.collect()] == ["x"]
    with pytest.raises(ValueError):
        G.restrict_to(frame(spark, a=[1]), ids)


def test_missing_rate_is_strictly_below(spark):
    t = frame(spark, a=[1, None], b=[1, 1], c=[None, None])
    assert set(values(G.filter_missing_rate(t, 0.5))) == {"b"}
    assert set(values(G.filter_missing_rate(t, 1.0))) == {"a", "b", "c"}
    assert set(values(G.drop_never_observed(t))) == {"a", "b"}


def test_row_at_the_cut_is_in_both_parts(spark):
    train, test = G.train_test(frame(spark, a=[1, 2, 3]), "2024-01-01 01:00:00")
    assert values(train) == {"a": [1.0, 2.0]} and values(test) == {"a": [2.0, 3.0]}
    early, late = G.split_at(frame(spark, a=[1, 2, 3]), "2024-01-01 01:00:00")
    assert values(early) == {"a": [1.0]} and values(late) == {"a": [2.0, 3.0]}


def test_integers_round_half_to_even(spark):
    assert values(G.cast_values(frame(spark, a=[0.5, 1.5, 2.5, None]), "int")) == {"a": [0, 2, 2, None]}


def test_mask_lacks_are_false(spark):
    t = frame(spark, a=[1, None])
    got = {r["ts"].hour: r["is_missing"] for r in G.align_mask(t, G.with_mask(t).where(F.hour("ts") == 1)).collect()}
    assert got == {0: False, 1: True}


def test_train_validation_counts_time_steps(spark):
    train, rest = G.train_validation(frame(spark, a=range(10), b=range(10)))
    assert (train.count(), rest.count()) == (16, 4)


def test_grid_of_off_grid_repeated_and_short_series(spark):
    """Against a plain join of all hours: off-grid rows go, but their sensor stays; repeated hours stay."""


    hour = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    rows = [("a", hour(0), 1.0), ("a", hour(6), 2.0), ("b", hour(3, 30), 3.0), ("c", hour(2), 4.0), ("c", hour(2), 5.0), ("c", hour(3), 6.0), ("c", hour(1, 15), 7.0), ("d", hour(6), None)]
    t = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, value double")
    for step in (1, 2, 3):
        want = []
        for s in "abcd":
            for h in range(0, 7, step):
                own = [v for i, ts, v in rows if i == s and ts == hour(h)]
                want += [(s, hour(h), v) for v in own or [None]]
        assert sorted(map(tuple, G.regular_grid(t, step).collect()), key=repr) == sorted(want, key=repr)
    assert G.regular_grid(t.limit(0)).count() == 0


def test_one_shuffle_by_sensor_from_counts_to_filled_parts(spark, monkeypatch):
    """What is written after the outlier steps stays dealt by sensor: no part shuffles again."""
    from sensorloom.operators import subset
    from sensorloom.queries import inputs

    plans = []
    real = subset.written_by
    monkeypatch.setattr(subset, "written_by", lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **b))
    parts = subset.make_subset(inputs.traffic(spark, "/root/testdata/sf0.001"), cut="2024-01-21 23:59:59", missing_rate=1.0)
    shuffles = lambda plan: plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(sensor_id")
    assert len(plans) == 1 and shuffles(plans[0]) == 1
    for name in ("full", "train", "test"):
        plan = parts[name]._jdf.queryExecution().executedPlan().toString()
        assert shuffles(plan) == 0 and "Exchange hashpartitioning" not in plan
