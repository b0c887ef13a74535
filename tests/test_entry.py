import datetime
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["flagship", "t1_last_row_wins", "t4_regular_grid", "t11_split_at", "o2_zeros_beside_gaps", "o8_trimmed_z", "o11_winsorized_z", "i1_linear", "i6_holiday_mean", "w1_sensor_windows", "w9_scale", "e1_scores", "s5_sensor_ids", "s13_sensor_points", "g8_link_locations"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)


@pytest.mark.parametrize("missing", ["sensorloom.llm", "corpus_pipeline", "zstandard", "public_tokenizers"])
def test_sensor_queries_stand_alone(missing):
    """Without the text operators, or without what they need, the others are there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == ["132", "128", "False"]
