"""Alignment of two tokenizers on the same texts, and how often their ids are linked.

Both tokenizers cut a blank and the text into tokens; where a token of each ends at the same byte, a group ends. The last tokens of a group are
linked: they end together. Nearly all groups are one token of each with the same bytes. Which B id has the bytes of an A id is one array, made
once, so such a regular group is counted by its A id alone, in a vector as long as the vocabulary. Only the links of the other groups are
shuffled, as pairs of ids with their number in a document. Pairs that are in over 1 / ``HEAVY`` of all those rows, ``HEAVY`` at most, are looked up in each
task; the rest by a join, so no pair, however frequent, meets in one task.

Null and empty texts, and texts whose tokens' bytes aren't a blank and the text again (B has no U+2581), have no tokens: all zeros, and ''. Very long texts
are aligned whole. Of equal counts all are the highest. Repeated rows, also of one ``doc_id`` or a null one, count and are returned each. An
empty table gives an empty one. Only ``doc_id`` and ``text`` are read; ``with_groups`` passes all other columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorloom.llm.batches import as_batch, free_name, id_and_text, lengths_to_offsets, map_whole_rows, slices, summed, text_slices
from sensorloom.llm.sentence_pieces import PieceModel
from sensorloom.llm.tokens import Vocabulary
from sensorloom.plans.scratch import written

#: At most so many pairs are looked up in every task.
HEAVY = 20_000
#: Bytes of text that are aligned together.
TOGETHER = 3 << 19


@dataclass(frozen=True)
class TokenizerPair:
    """A byte-level vocabulary (A) and a vocabulary of sentence pieces (B)."""

    first: Vocabulary = Vocabulary(special=None)
    second: PieceModel = PieceModel()

    def load(self) -> Aligner:
        return Aligner(self)


@dataclass
class Aligned:
    """Tokens of the texts of one batch, one after the other, and their groups."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray  # of each text
    b_ends: np.ndarray
    a_last: np.ndarray  # whether a token is the last of its group
    b_last: np.ndarray

    def group_ends(self) -> np.ndarray:
        return lengths_to_offsets(self.a_last)[self.a_ends]


class Aligner:
    """``align(texts)`` for one pair of tokenizers."""

    def __init__(self, pair: TokenizerPair) -> None:
        self.encoder, self.pieces = pair.first.encoder(), pair.second.load()
        self.a_bytes, self.b_bytes = self.encoder.token_bytes(), self.pieces.piece_bytes
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        ids = sorted(range(len(self.b_bytes)), key=lambda i: not self.pieces.is_byte[i])  # a piece goes before a byte
        of_bytes = {self.b_bytes[i]: i for i in reversed(ids) if self.b_bytes[i]}
        #: The B id with the bytes of an A id, or -1.
        self.same = np.array([of_bytes.get(x, -1) for x in self.a_bytes], np.int64)

    def _spelt(self, tokens: np.ndarray, ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        data, at = b"".join(tokens[ids].tolist()), lengths_to_offsets(sizes[ids])[ends]
        return np.array([data[x:y] == t for x, y, t in zip(at, at[1:], texts, strict=False)], bool)

    def align(self, texts: list[str | None]) -> Aligned:
        spaced = [f" {t}" if t else "" for t in texts]
        each = [self.encoder.ids(t) for t in spaced]
        a, a_ends = np.concatenate([*each, np.zeros(0, np.uint32)]).astype(np.int64), lengths_to_offsets([len(x) for x in each])
        b, b_ends = self.pieces.ids(texts)
        b, data = b.astype(np.int64), [t.encode("utf-8") for t in spaced]
        good = self._spelt(self.a_bytes, a, a_ends, self.a_size, data) & self._spelt(self.b_bytes, b, b_ends, self.b_size, data)
        if not good.all():
            a, b = a[np.repeat(good, np.diff(a_ends))], b[np.repeat(good, np.diff(b_ends))]
            a_ends, b_ends = lengths_to_offsets(np.diff(a_ends) * good), lengths_to_offsets(np.diff(b_ends) * good)
        # Both tokenizers now spell the same bytes for each text, so ends can be compared over the whole batch.
        a_at, b_at = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros((2, int(a_at[-1]) + 1 if len(a) else 1), bool)
        ends[0, a_at], ends[1, b_at] = True, True
        return Aligned(a, b, a_ends, b_ends, ends[1, a_at], ends[0, b_at])


def _interleaved(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of A's and B's tokens when each group's A tokens are followed by its B tokens, and the texts' ends."""
    a_after, b_after = np.nonzero(x.a_last)[0] + 1, np.nonzero(x.b_last)[0] + 1
    group_a, group_b = np.cumsum(x.a_last) - x.a_last, np.cumsum(x.b_last) - x.b_last
    return np.arange(len(x.a)) + np.append(0, b_after)[group_a], np.arange(len(x.b)) + a_after[group_b] if len(x.b) else np.zeros(0, np.int64), x.a_ends + x.b_ends


class _Speller:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.n_b = n_a, n_b
        self.table = np.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)], object)

    def __call__(self, x: Aligned) -> list[str]:
        a_at, b_at, ends = _interleaved(x)
        items = np.empty(len(x.a) + len(x.b), np.int64)
        items[a_at] = x.a + self.n_a * x.a_last
        items[b_at] = 2 * self.n_a + x.b + self.n_b * x.b_last
        return ["".join(self.table[items[i:j]].tolist())[:-1] for i, j in zip(ends, ends[1:], strict=False)]


def groups_column(docs: DataFrame) -> str:
    """The column that ``with_groups`` adds."""
    return free_name(docs, "groups")


def with_groups(docs: DataFrame, pair: TokenizerPair = TokenizerPair()) -> DataFrame:
    """``docs`` with a column of ``array<struct<a array<int>, b array<int>>>``, named by ``groups_column``."""
    kind = T.StructType.fromDDL("groups array<struct<a: array<int>, b: array<int>>>")["groups"].dataType
    schema = T.StructType([*docs.schema.fields, T.StructField(groups_column(docs), kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, arrow = pair.load(), to_arrow_schema(schema)
        item = arrow[-1].type.value_type
        for batch in text_slices(batches, "text", TOGETHER):
            x = aligner.align(batch.column("text").to_pylist())
            sides = [pa.ListArray.from_arrays(pa.array(np.append(0, np.nonzero(last)[0] + 1), pa.int32()), pa.array(ids, pa.int32())) for ids, last in ((x.a, x.a_last), (x.b, x.b_last))]
            groups = pa.ListArray.from_arrays(pa.array(x.group_ends(), pa.int32()), pa.StructArray.from_arrays(sides, fields=list(item)))
            yield pa.RecordBatch.from_arrays([*batch.columns, groups.cast(arrow[-1].type)], schema=arrow)

    return map_whole_rows(docs, run, schema)


def _listed(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[pa.Array, pa.Array]:
    """For each row its distinct keys, and how often each occurs, as lists."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.nonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else [])[0]
    ends = pa.array(np.searchsorted(rows[first], np.arange(n_rows + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(keys[first])), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(first, len(rows)))))


def document_links(docs: DataFrame, pair: TokenizerPair = TokenizerPair()) -> DataFrame:
    """For each row its token and group counts, the digest of its groups, and its links: ``same`` and ``same_n`` are the A ids of regular groups and their
    numbers, ``pairs`` and ``pairs_n`` the other links as ``a << 32 | b``. ``row`` differs for all rows: write the table before it is read twice."""
    schema = T.StructType.fromDDL(
        "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, same array<long>, same_n array<long>, pairs array<long>, pairs_n array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, arrow = pair.load(), to_arrow_schema(schema)
        speller = _Speller(len(aligner.a_bytes), len(aligner.b_bytes))
        for batch in text_slices(batches, "text", TOGETHER):
            x = aligner.align(batch.column("text").to_pylist())
            n, ends = batch.num_rows, x.group_ends()
            rows = np.repeat(np.arange(n), np.diff(ends))
            a, b = x.a[x.a_last], x.b[x.b_last]
            regular = aligner.same[a] == b  # tokens with the same bytes that end together also start together: they are the whole group
            same, same_n = _listed(rows[regular], a[regular], n)
            pairs, pairs_n = _listed(rows[~regular], a[~regular] << 32 | b[~regular], n)
            yield as_batch(
                {
                    "row": batch.column("row"),
                    "doc_id": batch.column("doc_id"),
                    "n_a": np.diff(x.a_ends),
                    "n_b": np.diff(x.b_ends),
                    "n_groups": np.diff(ends),
                    "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in speller(x)],
                    "same": same.cast(arrow.field("same").type),
                    "same_n": same_n.cast(arrow.field("same_n").type),
                    "pairs": pairs.cast(arrow.field("pairs").type),
                    "pairs_n": pairs_n.cast(arrow.field("pairs_n").type),
                },
                arrow,
            )

    return id_and_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def _pairs_apart(links: DataFrame) -> DataFrame:
    return links.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pairs_n").alias("n"))


def _regular_counts(links: DataFrame, size: int) -> np.ndarray:
    """How many regular groups have each A id."""

    def make():
        def count(batch: pa.RecordBatch) -> np.ndarray:
            return np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), size)

        return count

    return summed(links.select("same", "same_n"), make, size).astype(np.int64)


@dataclass
class LinkCounts:
    """How often ids are linked over all documents."""

    regular: np.ndarray  # by A id, to the B id in ``same``
    same: np.ndarray
    pairs: DataFrame  # pair, count, n_rows: the other pairs
    best: np.ndarray  # by B id, its highest count

    def table(self) -> DataFrame:
        """``a_id, b_id, n_links`` of all linked pairs."""
        spark, at = self.pairs.sparkSession, np.nonzero(self.regular)[0]
        regular = spark.createDataFrame(pd.DataFrame({"a_id": at, "b_id": self.same[at], "n_links": self.regular[at]}), "a_id long, b_id long, n_links long")
        return self.pairs.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), F.col("count").alias("n_links")).union(regular)


def count_links(links: DataFrame, pair: TokenizerPair = TokenizerPair()) -> LinkCounts:
    """Counts over ``links``, a written table of ``document_links``."""
    aligner = pair.load()
    regular = _regular_counts(links, len(aligner.a_bytes))
    pairs = written(_pairs_apart(links).groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_rows")))
    best = np.zeros(len(aligner.b_bytes), np.int64)
    at = np.nonzero(regular)[0]
    np.maximum.at(best, aligner.same[at], regular[at])
    most = pairs.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most")).toPandas()  # a row for each B id at most
    np.maximum.at(best, most["b"].to_numpy(np.int64), most["most"].to_numpy(np.int64))
    return LinkCounts(regular, aligner.same, pairs, best)


def scored_links(links: DataFrame, counts: LinkCounts) -> DataFrame:
    """For each row of ``links`` ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = links.sparkSession
    total = counts.pairs.agg(F.sum("n_rows")).first()[0] or 0
    often = F.col("n_rows") * HEAVY > total
    heavy = counts.pairs.where(often).orderBy("pair").toPandas()
    known = spark.sparkContext.broadcast((counts.regular, counts.same, counts.best, heavy["pair"].to_numpy(np.int64), heavy["count"].to_numpy(np.int64)))
    plain = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    schema = T.StructType.fromDDL(f"{plain}, n_best long, count_sum long, pairs array<long>, pairs_n array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular, same, best, pairs, pair_counts = known.value
        is_best, pair_best = (regular == best[same]).astype(np.int64), (pair_counts == best[pairs & 0xFFFFFFFF]).astype(np.int64)
        arrow = to_arrow_schema(schema)
        for batch in slices(batches):

            def sums(ids: np.ndarray, n: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
                return np.diff(lengths_to_offsets(n * of[ids])[ends])

            def lists(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                own = batch.column(name)
                return own.flatten().to_numpy(), batch.column(f"{name}_n").flatten().to_numpy(), own.offsets.to_numpy() - own.offsets[0].as_py()

            ids, n, ends = lists("same")
            count_sum, n_best = sums(ids, n, ends, regular), sums(ids, n, ends, is_best)
            ids, n, ends = lists("pairs")
            at = np.searchsorted(pairs, ids)
            found = np.append(pairs, -1)[at] == ids
            count_sum, n_best = count_sum + sums(at, n * found, ends, np.append(pair_counts, 0)), n_best + sums(at, n * found, ends, np.append(pair_best, 0))
            left_ends = pa.array(lengths_to_offsets(~found)[ends], pa.int32())
            left = {name: pa.ListArray.from_arrays(left_ends, pa.array(x[~found])).cast(arrow.field(name).type) for name, x in (("pairs", ids), ("pairs_n", n))}
            yield as_batch({f.name: batch.column(f.name) for f in list(arrow)[:6]} | {"n_best": n_best, "count_sum": count_sum} | left, arrow)

    rows = written(links.mapInArrow(run, schema))
    best = spark.createDataFrame(pd.DataFrame({"b": np.arange(len(counts.best)), "most": counts.best}), "b long, most long")
    rare = counts.pairs.where(~often).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))
    rest = _pairs_apart(rows).join(rare, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("more_sum"), F.sum(F.col("n") * F.col("is_best")).alias("more_best"))
    return rows.join(rest, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by both public vocabularies."""
    links = written(document_links(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return scored_links(links, count_links(links))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
