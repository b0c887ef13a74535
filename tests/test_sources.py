import datetime as dt
import os

import pytest
from test_grid import T0, frame, values

from sensorloom.operators.grid import with_mask
from sensorloom.operators.subset import make_subset
from sensorloom.sources import payloads as P
from sensorloom.sources import tables as T


def test_tables_round_trip(spark, tmp_path):
    t = frame(spark, a=[1, None, 3], b=[4, 5, None])
    T.write_traffic(t, f"{tmp_path}/t")
    assert values(T.read_traffic(spark, f"{tmp_path}/t")) == values(t)
    assert values(T.from_wide(T.to_wide(t))) == values(t)
    T.write_mask(with_mask(t), f"{tmp_path}/m")
    assert T.read_mask(spark, f"{tmp_path}/m").where("is_missing").count() == 2
    with pytest.raises(ValueError):
        T.read_mask(spark, f"{tmp_path}/t")


def test_ids_keep_order_and_distances_keep_zeros(spark, tmp_path):
    ids = spark.createDataFrame([(1, "007"), (0, "12"), (2, "3")], "idx int, sensor_id string")
    T.write_ids(ids, f"{tmp_path}/i")
    assert [r["sensor_id"] for r in T.read_ids(spark, f"{tmp_path}/i").orderBy("idx").collect()] == ["12", "007", "3"]
    d = spark.createDataFrame([("007", "12", 1.5)] * 2, T.DISTANCES)
    T.write_distances(d, f"{tmp_path}/d")
    assert [tuple(r) for r in T.read_distances(spark, f"{tmp_path}/d").collect()] == [("007", "12", 1.5)] * 2


def test_locations_with_and_without_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("lon,id,lat,other\n127.5,007,37.5,x\n")
    (tmp_path / "n.csv").write_text("12,37.5,127.5\n")
    assert tuple(T.read_locations(spark, f"{tmp_path}/h.csv", "id", "lat", "lon").first()) == ("007", 37.5, 127.5)
    assert tuple(T.read_locations(spark, f"{tmp_path}/n.csv").first()) == ("12", 37.5, 127.5)


def test_export_has_exactly_the_files_it_takes(spark, tmp_path):
    t = frame(spark, a=[*range(50)], b=[None, *range(49)])
    for limit, counts in ((20, [20, 20, 10]), (25, [25, 25]), (50, [50]), (1000, [50])):
        T.export_wide(t, path := f"{tmp_path}/w{limit}", limit)
        names = sorted(f for f in os.listdir(path) if not f.startswith((".", "_")))
        assert names == [f"part-{k:05d}.csv" for k in range(len(counts))]
        texts = [open(f"{path}/{name}").read().splitlines() for name in names]
        assert [len(x) - 1 for x in texts] == counts and {x[0] for x in texts} == {"ts,a,b"}
        lines = [line for x in texts for line in x[1:]]
        assert lines == sorted(lines)


def test_wide_tables_of_many_sensors(spark):
    wide = T.to_wide(frame(spark, **{f"s{k}": [k] for k in range(10_050)}).select("sensor_id", "ts", "value"))
    assert len(wide.columns) == 10_051


def test_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"day": "2024-01-01", "response": {"header": {"resultCode": "00"}, "body": {"items": [{"statDate": "2024-01-01", "linkID": "a", "hour00": 1.0}]}}}\n{"day": "2024-01-02", "response": {"header": {"resultCode": "03"}, "body": {"items": []}}}\n')
    p = P.read_payloads(spark, f"{tmp_path}/p.json")
    with pytest.warns(UserWarning):
        rows = P.payload_rows(p)
    assert [r["linkID"] for r in rows.collect()] == ["a"]
    with pytest.raises(ValueError):
        P.payload_rows(p, ignore_empty=False)
    assert P.check_date_range(rows, "2024-01-01", "2024-01-01").count() == 1
    with pytest.raises(ValueError):
        P.check_date_range(rows, "2024-01-01", "2024-01-02")


def test_training_part_never_sees_test_hours(spark):
    t = frame(spark, a=[10, *[None] * 23, None, *[None] * 23, 90])
    parts = make_subset(t, cut="2024-01-02 12:00:00", missing_rate=1.0)
    assert values(parts["train"])["a"][24] == 10.0 and values(parts["full"])["a"][24] == 50.0
    assert parts["train_missing"].where("is_missing").count() == 36


def test_wide_blocks_of_many_sensors(spark, tmp_path):
    """2,500 sensors with gaps and absent hours in blocks of 1,000; a column's name tells nothing of its sensor."""
    rows = [(f"s{k:05d}", T0 + dt.timedelta(hours=t), None if (k + t) % 7 == 0 else float(k * 10 + t)) for k in range(2500) for t in range(3) if (k, t) != (4, 1)]
    table = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, value double")
    T.write_wide(table, str(tmp_path / "wide"))
    back = T.read_wide(spark, str(tmp_path / "wide"))
    got = {(r["sensor_id"], r["ts"]): r["value"] for r in back.collect()}
    assert got == {(s, t): v for s, t, v in rows} | {("s00004", T0 + dt.timedelta(hours=1)): None}
    assert len(spark.read.parquet(str(tmp_path / "wide" / "values")).columns) == 1002


def test_fingerprints(spark):
    import duckdb

    from sensorloom.plans.fingerprint import fingerprint, fingerprint_sql

    rows = [("a", 1, 0.5, True), ("b", None, None, None), (None, 3, -2.25, False), ("a", 1, 0.5, True)]
    table = spark.createDataFrame(rows, "s string, n int, `from` double, b boolean")
    one = fingerprint(table).first()
    assert one == fingerprint(table.orderBy("n").select("b", "from", "n", "s")).first() and one["n_rows"] == 4
    others = [rows[:3], [*rows[:3], ("a", 1, 0.500002, True)], [*rows[:3], ("", 1, 0.5, True)], []]
    assert len({fingerprint(spark.createDataFrame(r, table.schema)).first()["digest"] for r in others} | {one["digest"]}) == 5
    con = duckdb.connect()
    con.execute('create table t (s varchar, n integer, "from" double, b boolean)')
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    assert con.execute(fingerprint_sql("t", {"s": "string", "n": "int", '"from"': "double", "b": "boolean"})).fetchall() == [tuple(one)]


def test_wide_cells_are_dealt_by_time_and_unpivoted_as_one_array(spark):
    """No task sends whole rows of a time that others have too; any name of a column comes back."""
    long = frame(spark, **{"a.b": [1, None, 3], "c`d": [4, 5, None], "e": [None, None, 6]})
    wide = T.to_wide(long)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    back = T.from_wide(wide)
    assert "Expand" not in back._jdf.queryExecution().executedPlan().toString() and back.columns == ["ts", "sensor_id", "value"]
    assert sorted(map(str, back.select(*long.columns).collect())) == sorted(map(str, long.collect()))


def test_export_joins_before_it_makes_columns(spark, tmp_path, monkeypatch):
    """What Spark infers for a join grows with the square of its columns, so the wide table is in none."""
    monkeypatch.setattr(T, "to_wide", lambda *_: pytest.fail("joined a wide table"))
    T.export_wide(frame(spark, b=[1, None, 3], a=[4, 5, None]), f"{tmp_path}/out", 2)
    assert sorted(f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".csv")) == ["part-00000.csv", "part-00001.csv"]
    lines = open(f"{tmp_path}/out/part-00000.csv").read().splitlines()
    assert lines[0] == "ts,a,b" and [line.split(",", 1)[1] for line in lines[1:]] == ["4.0,1.0", "5.0,"]
