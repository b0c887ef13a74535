"""Best-fit packing of documents into sequences, by patterns of lengths.

1. Every document becomes token ids with an end id. Longer ones than a sequence are cut; the first piece
   takes the remainder, all others are full.
2. Pieces are counted by length. This histogram, of at most ``capacity`` rows, is all that reaches the driver.
3. Patterns of up to three pieces that fill a sequence exactly are enumerated over the lengths that occur,
   and non-negative least squares fits how often each is repeated. The counts are rounded and held to what
   the histogram has; the residual is packed by best fit, largest first, again as patterns with counts.
4. Each piece gets its rank among the pieces of its length, and the rank finds its pattern, copy and place.

Ranks come from a window over (length, bucket of the id's hash) plus the counts of the buckets before, so a
length that a third of all pieces have is ordered in as many parts as there are buckets.

Null text counts as empty and gives one piece, the end id. A null ``doc_id`` is kept. Very long texts are encoded and cut whole. Repeated
rows are packed each for itself; pieces that tie in id, number and place go in order of their ids' checksum, and equal ones are alike. An empty table gives an empty result. Other columns than ``doc_id`` and ``text``
aren't read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.batches import id_and_text, map_batches
from sensorloom.llm.tokens import ID, Vocabulary
from sensorloom.plans.scratch import written


@dataclass(frozen=True)
class Slots:
    """Places for the pieces of each length, ordered by length and first rank."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    end = np.array([end_id], ID)

    def make():
        encoder = vocabulary.encoder()

        def cut(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.ids(text), end])
                n = len(ids)
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for name, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        out[name].append(value)
            return out

        return cut

    return map_batches(id_and_text(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence with one to three of the lengths present; zeros pad the rows."""
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    a = present[:, None]
    b = np.concatenate([[0], present])[None, :]
    c = capacity - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = (np.broadcast_to(x, fits.shape)[fits] for x in (a, b, c))
    keep = (c == 0) | there[c]
    return np.stack([a, b, c], 1)[keep]


def repeat_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares for ``sum of patterns = counts``, by accelerated projected gradients."""
    n = len(counts)
    used = patterns > 0

    def lengths_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), np.where(used, x[:, None], 0).ravel(), n)

    def patterns_of(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[patterns], 0).sum(1)

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = patterns_of(lengths_of(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(patterns_of(lengths_of(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * patterns_of(lengths_of(y) - counts))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use up the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    chosen: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        chosen.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    present = np.nonzero(counts)[0]
    if len(present):
        patterns = exact_patterns(present, capacity)
        if len(patterns):
            x = repeat_counts(patterns, counts.astype(float))
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 0.5:
                    break
                pattern = tuple(int(v) for v in patterns[k] if v)
                n = min([int(x[k] + 0.5), *(int(counts[v]) // pattern.count(v) for v in pattern)])
                if n:
                    chosen.append((pattern, n))
                    for v in pattern:
                        counts[v] -= n
    return chosen + best_fit(counts, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on counts: the fullest sequence is repeated until one of its lengths runs out."""
    left, chosen = counts.copy(), []
    for top in range(capacity, 0, -1):
        while left[top]:
            pattern, room, used = [top], capacity - top, {top: 1}
            while room:
                # Prefer the largest piece that fits; two that fill the room exactly go before it.
                there = [v for v in range(room, 0, -1) if left[v] > used.get(v, 0)]
                if not there:
                    break
                best = [there[0]]
                if there[0] < room:
                    rest = set(there)
                    best = next(([v, room - v] for v in there if room - v in rest and (2 * v != room or left[v] > used.get(v, 0) + 1)), best)
                for v in best:
                    pattern.append(v)
                    used[v] = used.get(v, 0) + 1
                    room -= v
            n = min(int(left[v]) // k for v, k in used.items())
            for v, k in used.items():
                left[v] -= n * k
            chosen.append((tuple(pattern), n))
    return chosen


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> Slots:
    """Runs of ranks of each length, with the sequence and offset that the first rank of a run goes to."""
    rows, sequence, used = [], 0, {}
    for pattern, n in chosen:
        offset = 0
        for v in pattern:
            rows.append((v, used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*table.T.copy(), n_sequences=sequence)


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, from 0, of each piece among those of its length."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return cut.withColumn("within", within).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("bucket", "within", "before")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; places in a sequence follow each other without gaps."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, end_id, vocabulary))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # bounded by the patterns of capacity
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def make():
        s = places.value
        start = np.searchsorted(s.length, np.arange(capacity + 2))
        wide = np.int64(1) << 40
        keys = s.length * wide + s.first if len(s.length) else np.zeros(0, np.int64)
        assert not len(start) or start[-1] == len(keys)

        def place(batch: pa.RecordBatch) -> dict:
            out = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            length, rank = (out[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * wide + rank, side="right") - 1
            return out | {"sequence_id": s.sequence[k] + rank - s.first[k], "offset": s.offset[k]}

        return place

    rows = ranked(cut, buckets).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return map_batches(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of ``documents`` in sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
