import random
import statistics

import pytest
from test_grid import frame, values

from sensorloom.operators import outliers as O


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ([0, 0, None, 5], [None, None, None, 5]),
        ([5, None, 0, 0], [5, None, None, None]),
        ([5, None, 0, None, 5], [5, None, None, None, 5]),
        ([0, 5, 0, 0, 6, 0], [0, 5, 0, 0, 6, 0]),
        ([5, 0, None, 0, 7, 0, 8], [5, None, None, None, 7, 0, 8]),
    ],
)
def test_zeros_beside_gaps(spark, given, wanted):
    assert values(O.zeros_beside_gaps()(frame(spark, a=given))) == {"a": [None if v is None else float(v) for v in wanted]}


def test_absolute_limit_and_chain(spark):
    got = values(O.chain(frame(spark, a=[-9, 0, 9, 3]), [O.absolute_limit(8), O.zeros_beside_gaps()]))
    assert got == {"a": [None, None, None, 3.0]}


def test_capacity(spark):
    meta = spark.createDataFrame([("a", 2, 80), ("b", 1, 110)], "LINK_ID string, LANES int, MAX_SPD int")
    assert values(O.road_capacity(meta)(frame(spark, a=[6000, 6001], b=[3450, 3451]))) == {"a": [6000.0, None], "b": [3450.0, None]}
    with pytest.raises(KeyError):
        O.road_capacity(meta)(frame(spark, z=[1]))


def test_trimming_nothing_blanks_the_sensor(spark):
    assert values(O.trimmed_z()(frame(spark, a=[1, 2, 3])))["a"] == [None] * 3
    many = [*range(1, 40), 1000]
    got = values(O.trimmed_z()(frame(spark, a=many)))["a"]
    assert got[-1] is None and got[:39] == [float(v) for v in many[:39]]


def test_winsorized_nulls(spark):
    one = [float(v) for v in range(1, 20)] + [None]  # k = 1: the NULL is the top cell and takes the next value
    assert values(O.winsorized_z(limit=99)(frame(spark, a=one)))["a"] == [2.0, *one[1:19], 19.0]
    two = [float(v) for v in range(1, 19)] + [None, None]  # more NULLs than k
    assert values(O.winsorized_z(limit=99)(frame(spark, a=two)))["a"] == [2.0, *two[1:18], None, None]


def test_constant_series_keeps_its_values(spark):
    t = frame(spark, a=[4] * 30)
    for step in (O.hourly_z(), O.sensor_z(), O.global_z(), O.median_deviation(), O.winsorized_z()):
        assert values(step(t))["a"] == [4.0] * 30
    with pytest.raises(ValueError):
        O.network_hourly_z()(t)


def test_median_deviation_against_plain_python(spark):
    rng = random.Random(1)
    series = [rng.gauss(50, 5) for _ in range(60)] + [400.0]
    med = statistics.median(series)
    mad = statistics.median(abs(v - med) for v in series)
    wanted = [v if 0.6745 * abs(v - med) / (mad + 1e-9) <= 3.5 else None for v in series]
    got = values(O.median_deviation()(frame(spark, a=series)))["a"]
    assert [v is None for v in got] == [v is None for v in wanted]


def test_status(spark):
    got = {r["sensor_id"]: r["ok"] for r in O.step_status(frame(spark, a=[1, 2, 3], b=[None, None, 1])).collect()}
    assert got == {"a": True, "b": False}


@pytest.mark.parametrize("counts", [[2, 2, 6, 6, 6, 6, 14], [3, 3, 5, 5, 5, 5, 9], [3, 3, 7, 7, 7, 7, 15], [4, 4, 6, 6, 6, 6, 10]])
@pytest.mark.parametrize("turned", [False, True])
def test_a_value_exactly_at_the_limit_stays(spark, counts, turned):
    """Twice the deviation from the mean, in whole numbers; sums of doubles put it on either side."""
    days = counts[::-1] if turned else counts
    hourly = [None] * (24 * len(days))
    hourly[::24] = days
    for step in (O.hourly_z(2.0), O.monthly_hourly_z(2.0)):
        assert values(step(frame(spark, a=hourly)))["a"][::24] == [float(v) for v in days]
    over = [v + (v == max(days)) for v in days]
    hourly[::24] = over
    assert values(O.hourly_z(2.0)(frame(spark, a=hourly)))["a"][::24] == [None if v > max(days) else float(v) for v in over]
