import hashlib
import math

import numpy as np
import pytest
from texts import seeded

from sensorloom.llm import vector_codes as V
from sensorloom.plans.scratch import written

SCHEMA = "vec_id long, embedding array<float>, label int, coded string, `a.b` int"


def naive(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in Python's integers; rows as (vec_id, vector, label)."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(good[0][1])
    x = [[math.floor(256 * float(np.float32(c))) for c in r[1]] if len(r[1]) == dims else None for r in good]
    size, own = dims // parts, [v for v in x if v is not None]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in own[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in own:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] if v is not None else None for v in x]
    out = [(r[0], r[2], "".join(f"{k:02x}" for _, k in f) if f else None, sum(d for d, _ in f) if f else None) for r, f in zip(good, found, strict=True)]
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + (error or 0)
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, code, error, sums[label]) for i, label, code, error in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 3) for i, v, label in rows], SCHEMA)


def results(spark, rows, **kw):
    df = frame(spark, rows).repartition(3)
    books = V.train(df, **kw)
    coded = V.with_codes(df, books)
    assert V.code_column(df) == "coded_" and coded.columns == [*df.columns, "coded_"]
    flat = written(coded.select("vec_id", "label", "coded_.code", "coded_.error"))
    found = V.with_label_errors(flat).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=str), books.sha256()


def vectors(seed, n, dims, spread=1.0, copies=0):
    rng = seeded(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    rows = [(k, [c + rng.gauss(0, 0.3 * spread) for c in rng.choice(centres)], rng.choice([1, 2, 2, 2, None])) for k in range(n)]
    return rows + [(n + k, rows[3][1], 2) for k in range(copies)]


@pytest.mark.parametrize("heavy", [1, 1000, 10**9])
def test_equal_to_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(V, "HEAVY_LABELS", heavy)
    rows = vectors(1, 220, 32, copies=40)
    assert results(spark, rows) == naive(rows)


def test_odd_rows(spark):
    rows = vectors(2, 90, 16, spread=0.02)
    bad = [None, [None] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [0.5] * 15 + [None]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(None, [0.25] * 16, None), (None, [-0.25] * 16, None), (5, rows[5][1], 2), (5, [0.1] * 16, 2), (2000, [1.0, 2.0], 7), (2001, [], 7)]
    assert results(spark, rows) == naive(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(k, [float(k % 3)] * 16, k % 2) for k in range(80)] + [(100, [0.5] * 16, 0), (101, [1.5] * 16, 0)]
    assert results(spark, rows) == naive(rows)


def test_few_and_no_vectors(spark):
    rows = vectors(3, 3, 48)
    assert results(spark, rows) == naive(rows)
    empty = frame(spark, [])
    assert V.train(empty) is None and V.with_codes(empty, None).count() == 0
    only_bad = frame(spark, [(1, None, 1), (2, [float("nan")], None)])
    assert V.train(only_bad) is None and V.with_codes(only_bad, None).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        V.train(frame(spark, [(1, [1.0] * 15, 1)]))


def test_cells_compare_few_entries_and_may_be_forgotten():
    rng = np.random.default_rng(0)
    books = V.Codebooks(rng.integers(-300, 300, (16, 64, 4)))
    x = rng.integers(-400, 400, (3000, 64))
    expected = ((x.reshape(-1, 16, 1, 4) - books.entries[None]) ** 2).sum(3)
    for cells in (V.CELLS, 10):
        coder = V.Coder(books, cells)
        for part in (x[:1000], x[1000:]):
            coder.codes(part)
        codes, errors = coder.codes(x)
        assert (codes == expected.argmin(2)).all() and (errors == expected.min(2).sum(1)).all()
    assert V.Coder(books).codes(x[:0])[0].shape == (0, 16)
    coder = V.Coder(books)
    coder.codes(x)
    assert coder.compared < 0.35 * x.shape[0] * 16 * 64
    with pytest.raises(ValueError, match="too large"):
        V._integers(V.pa.array([[1e30] * 4]), 4)


def test_restored(spark):
    rows = vectors(4, 70, 16)
    df = frame(spark, rows)
    books = V.train(df)
    coded = V.with_codes(df, books).select("embedding", "coded_.code", "coded_.error")
    for r in V.restored(coded, books).collect():
        got = sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(r["embedding"], r["restored"], strict=True))
        assert got == r["error"]
