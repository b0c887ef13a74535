import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_grid import T0, frame, values

from sensorloom.operators import fills as L


def test_linear_edges(spark):
    t = frame(spark, a=[None, 2, None, None, 8, None], b=[None, None, None, None, None, None])
    assert values(L.linear()(t)) == {"a": [None, 2.0, 4.0, 6.0, 8.0, 8.0], "b": [None] * 6}
    assert values(L.spline()(t)) == {"a": [None, 2.0, 4.0, 6.0, 8.0, None], "b": [None] * 6}


@pytest.mark.parametrize(("method", "wanted"), [("linear", [2, 2, 4, 6, 6]), ("ffill", [2, 2, 2, 6, 6]), ("bfill", [2, 2, 6, 6, 6]), ("median", [4, 2, 4, 6, 4]), ("odd name", [2, 2, 4, 6, 6])])
def test_fallbacks(spark, method, wanted):
    got = values(L.fallback(method)(frame(spark, a=[None, 2, None, 6, None], b=[None] * 5)))
    assert got == {"a": [float(v) for v in wanted], "b": [0.0] * 5}


def test_hour_mean_rounds_observed_values_too(spark):
    t = frame(spark, a=[2.5] + [None] * 23 + [None])
    assert values(L.hour_mean()(t))["a"] == [2.0, *[None] * 23, 2.0]


def test_shift_takes_the_latest_original(spark):
    assert values(L.shifted(2)(frame(spark, a=[1, None, None, 5, None, None])))["a"] == [1.0, None, 1.0, 5.0, 1.0, 5.0]


def test_holiday_mean(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 2),)], "date date")  # 1 January 2024 is a Monday
    series = [None] * 24 * 7
    series[0], series[24], series[24 * 5] = 10, 100, 200  # Monday, the holiday, Saturday, all at midnight
    got = values(L.holiday_mean(days)(frame(spark, a=series)))["a"]
    assert got[24 * 6] == 150.0 and got[24 * 2] == 10.0 and got[1] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series=st.lists(st.one_of(st.none(), st.integers(0, 50)), min_size=1, max_size=12))
def test_fallback_fills_all_and_moves_nothing(spark, series):
    got = values(L.fallback()(frame(spark, a=series)))["a"]
    assert all(g is not None and (v is None or g == v) for g, v in zip(got, series, strict=True))


def test_write_back_keeps_observed(spark):
    t = frame(spark, a=[1, None, None])
    model = spark.createDataFrame([("a", T0 + dt.timedelta(hours=k), 9.0) for k in range(2)], "sensor_id string, ts timestamp_ntz, imputed double")
    assert values(L.write_back(t, model))["a"] == [1.0, 9.0, None]
