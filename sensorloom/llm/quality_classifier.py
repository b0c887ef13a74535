"""A quality classifier from positive and unlabelled documents.

Trusted positives are labelled documents of good quality; all documents, whatever their label, are the
unlabelled web text. Negative labels are never used. Each text becomes levels of a few style measures.
Documents of equal levels are one cell, so one pass over the texts leaves a small table of cells with counts,
and every sum below runs over all documents.

With the logistic loss the unbiased risk of positive-unlabelled learning is ``prior * mean of -g over
positives + mean of log(1 + exp(g)) over unlabelled`` and convex; Newton steps minimise it. The part that
stands for negatives, ``mean over unlabelled of log(1 + exp(g)) - prior * mean over positives of it``, can't
truly be negative: a step that makes it so is shortened until it isn't (du Plessis 2015, Kiryo 2017).

The class prior is the least ratio of unlabelled to positive mass over the upper sets of a first classifier
that tells positives from unlabelled, with an allowance for the size of the sample.

Null and empty texts have levels like any other, very long ones are measured whole. Repeated rows are scored each. Texts of equal levels have equal
scores. Without any positive to learn from every score is 1, so nothing is rejected. An empty table gives an empty result. Other columns than ``doc_id`` and
``text``, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.batches import id_and_text, map_batches, summed
from sensorloom.llm.folds import held_out, learnable
from sensorloom.llm.quality_rules import TextCounts
from sensorloom.plans.scratch import written

#: Upper ends of the levels of each measure.
LEVELS: dict[str, list[float]] = {
    "marks_per_word": [0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 1.5],
    "bars_per_word": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "exclaims_per_word": [0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 1.5],
    "capital_share": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "repeat_share": [0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75],
    "same_next_share": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7],
    "dup_line_share": [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75],
    "word_chars": [2.0, 3.0, 4.0, 5.5, 7.0, 9.0, 14.0],
    "digit_share": [0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "n_words": [1.0, 5.0, 15.0, 50.0, 200.0, 1000.0, 5000.0],
}
_DIGITS = b"0123456789"
_SIZE = 1 + 8 * len(LEVELS)


def measures(text: str | None) -> list[float]:
    """The style measures in the order of ``LEVELS``."""
    c = TextCounts(text)
    n, size = max(1, c.n_words), max(1, len(c.data))
    same = sum(a == b for a, b in zip(c.words, c.words[1:], strict=False))
    bars = c.data.count(b"|")
    return [
        (c.n_symbols - bars) / n,
        bars / n,
        c.n_exclaims / n,
        c.n_capitals / max(1, c.n_capitals + c.n_small),
        c.n_repeat_words / n,
        same / n,
        c.n_dup_lines / max(1, c.n_lines),
        c.word_chars / n,
        (len(c.data) - len(c.data.translate(None, _DIGITS))) / size,
        float(c.n_words),
    ]


def cell_levels(docs: DataFrame) -> DataFrame:
    """``doc_id, cell``: the levels of each text, three bits for each measure."""

    def make():
        edges = list(LEVELS.values())

        def level(batch: pa.RecordBatch) -> dict:
            found = np.array([measures(t) for t in batch.column(1).to_pylist()])
            cell = np.zeros(len(found), np.int64)
            for k, ends in enumerate(edges):
                cell |= np.searchsorted(ends, found[:, k], side="right") << 3 * k
            return {"doc_id": batch.column(0), "cell": cell}

        return level

    return map_batches(id_and_text(docs), make, "doc_id long, cell long")


def indicators(cells: np.ndarray) -> np.ndarray:
    """One column for each level of each measure, and a constant."""
    levels = cells[:, None] >> 3 * np.arange(len(LEVELS)) & 7
    out = np.zeros((len(cells), _SIZE))
    out[:, 0] = 1
    np.put_along_axis(out, 1 + 8 * np.arange(len(LEVELS)) + levels, 1, 1)
    return out


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _sums(cells: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Gradient and curvature of the unlabelled sum of log(1 + exp(g)), that sum, and the same sum over positives."""

    def make():
        def add(batch: pa.RecordBatch) -> np.ndarray:
            cell, n, positive = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = indicators(cell)
            g = x @ w
            p = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            curve = (x * (n * p * (1 - p))[:, None]).T @ x
            return np.concatenate([x.T @ (n * p), curve.ravel(), [(n * _softplus(g)).sum(), (positive * _softplus(g)).sum()]])

        return add

    total = summed(cells, make, _SIZE + _SIZE**2 + 2)
    return total[:_SIZE], total[_SIZE:-2].reshape(_SIZE, _SIZE), total[-2], total[-1]


def _totals(cells: DataFrame) -> tuple[float, float, np.ndarray]:
    """Documents, positives, and the positives' sum of indicators."""

    def make():
        def add(batch: pa.RecordBatch) -> np.ndarray:
            cell, n, positive = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            return np.concatenate([[n.sum(), positive.sum()], positive @ indicators(cell)])

        return add

    total = summed(cells, make, 2 + _SIZE)
    return total[0], total[1], total[2:]


def minimise(cells: DataFrame, prior: float, ridge: float = 1e-3, rounds: int = 12) -> np.ndarray:
    """Weights of least non-negative risk."""
    n, n_positive, positive = _totals(cells)
    w, pull = np.zeros(_SIZE), prior * positive / n_positive
    gradient, curve, unlabelled, of_positive = _sums(cells, w)
    for _ in range(rounds):
        slope = gradient / n - pull + ridge * w
        step = np.linalg.solve(curve / n + ridge * np.eye(_SIZE), slope)
        size, risk = 1.0, unlabelled / n - pull @ w + ridge / 2 * w @ w
        while True:
            new = w - size * step
            found = _sums(cells, new)
            negative = found[2] / n - prior * found[3] / n_positive
            if negative >= 0 and found[2] / n - pull @ new + ridge / 2 * new @ new <= risk + 1e-12 or size < 0.02:
                break
            size /= 2
        if size < 0.02 and negative < 0:
            break
        done = np.abs(new - w).max() < 1e-3
        w, (gradient, curve, unlabelled, of_positive) = new, found
        if done:
            break
    return w


def class_prior(cells: DataFrame, bins: int = 400) -> float:
    """Share of positives among the unlabelled: the least ratio of masses over upper sets of a classifier's scores."""
    w = minimise(cells, prior=0.5)

    def make():
        def add(batch: pa.RecordBatch) -> np.ndarray:
            cell, n, positive = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = np.minimum((bins / (1 + np.exp(-np.clip(indicators(cell) @ w, -500, 500)))).astype(int), bins - 1)
            return np.concatenate([np.bincount(at, n, bins), np.bincount(at, positive, bins)])

        return add

    total = summed(cells, make, 2 * bins)
    mass, of_positive = (np.cumsum(v[::-1]) for v in (total[:bins], total[bins:]))
    allowed = np.sqrt(np.log(20) / max(1.0, of_positive[-1])) + np.sqrt(np.log(20) / max(1.0, mass[-1]))
    share = of_positive / of_positive[-1]
    return float(np.clip(np.min((mass / mass[-1] + allowed * (share < 1))[share > 0.5] / share[share > 0.5]), 0.05, 0.98))


def fit(levels: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights learnt from all of ``levels`` and the positives among ``labels``; None without positives."""
    positives = learnable(labels, "quality").where(F.col("label") == 1).select("doc_id", F.lit(1).alias("is_positive"))
    marked = levels.join(positives, "doc_id", "left")
    cells = written(marked.groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count("is_positive").cast("double").alias("n_positive")))
    if cells.where(F.col("n_positive") > 0).isEmpty():
        return None
    return minimise(cells, class_prior(cells))


def scored(levels: DataFrame, w: np.ndarray | None) -> DataFrame:
    """``doc_id, score``, the likelihood of good quality."""

    def make():
        def score(batch: pa.RecordBatch) -> dict:
            g = indicators(batch.column(1).to_numpy(zero_copy_only=False)) @ w if w is not None else np.full(batch.num_rows, np.inf)
            return {"doc_id": batch.column(0), "score": 1 / (1 + np.exp(-np.clip(g, -500, 500)))}

        return score

    return map_batches(levels, make, "doc_id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``."""
    levels = written(cell_levels(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = scored(levels, fit(levels, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
