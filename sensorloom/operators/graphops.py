"""Graph operators on sparse matrices ``src_idx, dst_idx, weight``; absent entries are 0, nothing is ever dense."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.plans.scratch import dropped, written, written_by

_COO = ("src_idx", "dst_idx", "weight")


def added(*parts: DataFrame) -> DataFrame:
    """The sum of matrices."""
    total = parts[0].select(*_COO)
    for part in parts[1:]:
        total = total.unionByName(part.select(*_COO))
    return total.groupBy("src_idx", "dst_idx").agg(F.sum("weight").alias("weight"))


def scaled(matrix: DataFrame, by: float) -> DataFrame:
    return matrix.select("src_idx", "dst_idx", (F.col("weight") * by).alias("weight"))


def identity(sensors: DataFrame) -> DataFrame:
    return sensors.select(F.col("idx").alias("src_idx"), F.col("idx").alias("dst_idx"), F.lit(1.0).alias("weight"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"), "weight")


def symmetric(matrix: DataFrame) -> DataFrame:
    """The greater of each entry and its mirror."""
    return matrix.select(*_COO).unionByName(transposed(matrix)).groupBy("src_idx", "dst_idx").agg(F.max("weight").alias("weight"))


def _by_degree(matrix: DataFrame, power: Column, left: bool, right: bool) -> DataFrame:
    """Rows and columns scaled by a power of the row sums; a sum of 0 scales by 0."""
    degree = matrix.groupBy("src_idx").agg(F.sum("weight").alias("_sum")).select(F.col("src_idx").alias("_at"), F.when(F.col("_sum") > 0, power).otherwise(0.0).alias("_by"))
    for side, wanted in (("src_idx", left), ("dst_idx", right)):
        if wanted:
            matrix = matrix.join(degree, F.col(side) == F.col("_at"), "left").select("src_idx", "dst_idx", (F.col("weight") * F.coalesce("_by", F.lit(0.0))).alias("weight"))
    return matrix


def shift_operator(adjacency: DataFrame, sensors: DataFrame, kind: str = "sym_norm_adj", force_symmetric: bool = True) -> DataFrame:
    """One of the eight {sym, rw}_{norm, renorm}_{adj, lap}: renorm adds the identity first, lap is identity minus adj.

    The adjacency is made symmetric first, unless that is not wanted.
    """
    side, norm, form = kind.split("_")
    if side not in ("sym", "rw") or norm not in ("norm", "renorm") or form not in ("adj", "lap"):
        raise ValueError(f"unknown operator {kind}")
    a = symmetric(adjacency) if force_symmetric else adjacency.select(*_COO)
    if norm == "renorm":
        a = added(a, identity(sensors))
    a = _by_degree(a, F.pow("_sum", F.lit(-0.5)), True, True) if side == "sym" else _by_degree(a, 1 / F.col("_sum"), True, False)
    return added(identity(sensors), scaled(a, -1.0)) if form == "lap" else a


def random_walk(adjacency: DataFrame, reverse: bool = False) -> DataFrame:
    """Rows divided by their sums; of the transpose for the reverse walk."""
    return _by_degree(transposed(adjacency) if reverse else adjacency.select(*_COO), 1 / F.col("_sum"), True, False)


def normalized_laplacian(adjacency: DataFrame, sensors: DataFrame) -> DataFrame:
    """Identity minus the transpose scaled on both sides by the inverse root of the row sums."""
    return added(identity(sensors), scaled(transposed(_by_degree(adjacency.select(*_COO), F.pow("_sum", F.lit(-0.5)), True, True)), -1.0))


def _dots(rows: DataFrame, basis: Column, vector: Column, size: int) -> np.ndarray:
    """The dot products of a vector with all vectors of a basis, whose values at each index are one array."""
    apart = rows.select(F.posexplode(basis).alias("k", "q"), vector.alias("w"))
    out = np.zeros(size)
    for r in apart.groupBy("k").agg(F.sum(F.col("q") * F.col("w")).alias("dot")).collect():  # a row for each vector of the basis
        out[r["k"]] = r["dot"]
    return out


def spectral_norm(matrix: DataFrame, sensors: DataFrame, steps: int = 300, tolerance: float = 1e-10) -> float:
    """The largest singular value, by Lanczos' recurrence on the transpose times the matrix; raises if it hasn't settled after ``steps``.

    A step is one product with the matrix and one with its transpose; both are kept bucketed by what the vector is joined on. The new vector is made
    orthogonal to all before it, twice. The driver has only the tridiagonal matrix of the recurrence: its largest eigenvalue is that of the product up to
    the square of the last vector's share in it over the distance to the next eigenvalue, which the tolerance bounds.
    """
    matrix = matrix.select(*_COO)
    by_dst, by_src = written_by(matrix, "dst_idx"), written_by(matrix, "src_idx")
    start = sensors.select("idx", (1 + F.pmod(F.xxhash64("idx"), F.lit(1000)) / 1000).alias("w"))  # no symmetry of the graph makes it orthogonal to the leading vector
    rows = written(start.select("idx", F.array().cast("array<double>").alias("basis"), "w"))
    diagonal: list[float] = []
    beside: list[float] = []
    size = float(rows.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0] or 0.0)
    against = np.zeros(0)
    try:
        for k in range(steps):
            if not size:
                return 0.0
            # The vector of the step before without its shares in the others, normed, joins the basis.
            fresh = (F.col("w") - _share("basis", against)) / size
            basis = rows.select("idx", F.array_append("basis", fresh).alias("basis"))
            last = basis.select("idx", F.element_at("basis", -1).alias("x"))
            y = by_dst.join(last, by_dst["dst_idx"] == last["idx"]).groupBy("src_idx").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
            w = by_src.join(y, "src_idx").groupBy(F.col("dst_idx").alias("idx")).agg(F.sum(F.col("weight") * F.col("y")).alias("w"))
            former, rows = rows, written(basis.join(w, "idx", "left").select("idx", "basis", F.coalesce("w", F.lit(0.0)).alias("w")))
            dropped(former)
            once = _dots(rows, F.col("basis"), F.col("w"), k + 1)
            left = F.col("w") - _share("basis", once)
            twice = _dots(rows, F.array_append("basis", left), left, k + 2)
            against = once + twice[:-1]
            diagonal.append(against[-1])
            size = max(0.0, twice[-1] - float(twice[:-1] @ twice[:-1])) ** 0.5
            values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
            top, share = values[-1], size * abs(vectors[-1, -1])
            apart = top - values[-2] if k else 0.0
            if share <= 1e-13 * top or k and min(share, share**2 / max(apart, 1e-300)) <= tolerance * top:
                return float(max(top, 0.0)) ** 0.5
            beside.append(size)
    finally:
        dropped(rows, by_dst, by_src)
    raise RuntimeError(f"the spectral norm still changes after {steps} steps")


def _share(basis: str, factors: np.ndarray) -> Column:
    """The sum of a basis' vectors times factors."""
    by = F.lit([float(f) for f in factors]) if len(factors) else F.array().cast("array<double>")
    return F.aggregate(F.zip_with(basis, by, lambda q, f: q * f), F.lit(0.0), lambda total, v: total + v)


def chebyshev_rescaled(operator: DataFrame, sensors: DataFrame) -> DataFrame:
    """Operator minus identity if its spectral norm is 2 or more, else 2 / norm times it minus identity."""
    norm = spectral_norm(operator, sensors)
    return added(scaled(operator, 1.0 if norm >= 2 or not norm else 2 / norm), scaled(identity(sensors), -1.0))


def scaled_laplacian(adjacency: DataFrame, sensors: DataFrame, lambda_max: float | None = 2.0, undirected: bool = True) -> DataFrame:
    """2 / lambda times the normalized Laplacian minus identity; None takes the largest eigenvalue."""
    laplacian = normalized_laplacian(symmetric(adjacency) if undirected else adjacency, sensors)
    if lambda_max is None:
        lambda_max = spectral_norm(laplacian, sensors)
    return added(scaled(laplacian, 2 / lambda_max), scaled(identity(sensors), -1.0))
