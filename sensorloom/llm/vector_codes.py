"""Vectors as short codes: each of 16 equal parts becomes the number of its nearest codebook entry, found by remembered grid cells.

Components become integers, floor(256 x). A part's space is cut into equal boxes; the box that a part lies in is the key under which a task
remembers the only entries that can be nearest to anything in it: those whose least distance to the box is no more than the smallest
greatest distance of any entry. Only these are then compared exactly, in integers. Codebooks start as parts of the first
vectors and move to floor(sum / count) of what they were nearest to; each round is one pass, of which tasks return sums of a fixed size.

Vectors that are null or hold null or non-finite components are dropped. Of equal distances the lower entry is taken. Repeated rows count each, also
where a ``vec_id`` repeats or is null (the first vectors are those with the smallest ids, then by components, nulls last). With fewer vectors than
entries the codebooks are shorter. A vector of another length than the first one's has a null code and error and moves no entry. An empty table gives an
empty one. A length that isn't a multiple of 16, or components so large that squared distances pass 2^63, raise. ``with_codes`` passes other
columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorloom.llm.batches import as_batch, free_name, lengths_to_offsets, map_whole_rows, slices
from sensorloom.llm.sentence_pieces import gathered
from sensorloom.plans.scratch import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Cells of a part that a task remembers; the memory is emptied when it is full.
CELLS = 100_000
#: Labels with over 1 / HEAVY_LABELS of all rows, so many at most, are looked up in each task.
HEAVY_LABELS = 1000


@dataclass
class Codebooks:
    """Entries by part, number and position, as integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def widths(self) -> np.ndarray:
        """Of the boxes of each part: half as much again as what lies between near entries, so that many parts share a box and few entries are left in it.
        The results don't depend on it."""
        out = []
        for book in self.entries:
            apart = ((book[:, None] - book[None]) ** 2).sum(2).astype(float)
            apart[apart == 0] = np.inf
            near = np.sqrt(apart.min(1))
            near = near[np.isfinite(near)]
            out.append(max(1, int(1.5 * np.median(near) / np.sqrt(max(1, book.shape[1])))) if len(near) else 1)
        return np.array(out, np.int64)


class Coder:
    """``codes(x)`` for integer vectors ``x``, of one task."""

    def __init__(self, books: Codebooks, cells: int = CELLS) -> None:
        self.books, self.widths, self.cells = books.entries, books.widths(), cells
        self.known: list[dict[bytes, np.ndarray]] = [{} for _ in self.books]
        self.compared = 0

    def _undominated(self, part: int, cells: np.ndarray) -> list[np.ndarray]:
        """For boxes the entries that may be nearest to a point in them."""
        low, book = (cells * self.widths[part])[:, None], self.books[part][None]
        high = low + self.widths[part] - 1
        least = (np.maximum(np.maximum(low - book, book - high), 0) ** 2).sum(2)
        most = (np.maximum(abs(book - low), abs(book - high)) ** 2).sum(2)
        return [np.nonzero(row)[0] for row in least <= most.min(1)[:, None]]

    def _part(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, known = np.ascontiguousarray(x // self.widths[part]), self.known[part]
        if not cells.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        _, first, which = np.unique(cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        keys = [cells[k].tobytes() for k in first]
        new = [k for k, key in enumerate(keys) if key not in known]
        if len(known) + len(new) > self.cells:
            known.clear()
            new = list(range(len(keys)))
        for start in range(0, len(new), 1024):
            some = new[start : start + 1024]
            known.update(zip([keys[k] for k in some], self._undominated(part, cells[first[some]]), strict=True))
        lists = [known[key] for key in keys]
        entries, ends = gathered(np.concatenate(lists), lengths_to_offsets([len(e) for e in lists]), which)
        rows = np.repeat(np.arange(len(x)), np.diff(ends))
        self.compared += len(rows)
        distances = ((x[rows] - self.books[part][entries]) ** 2).sum(1)
        best = np.minimum.reduceat(distances, ends[:-1])
        at = np.nonzero(distances == best[rows])[0]
        at = at[np.concatenate([[True], rows[at][1:] != rows[at][:-1]])]  # entries ascend, so of ties the lowest is first
        return entries[at], best

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest entries by part, and the sum of the squared distances."""
        size = self.books.shape[2]
        out, errors = np.zeros((len(x), len(self.books)), np.int64), np.zeros(len(x), np.int64)
        for part in range(len(self.books)) if len(x) else ():
            out[:, part], distances = self._part(part, x[:, part * size : (part + 1) * size])
            errors += distances
        return out, errors


def _integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept, which of them have ``dims`` components, and the integers of those."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    values = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    wrong = np.add.reduceat(np.append(~np.isfinite(values), False).astype(np.int64), lengths_to_offsets(np.maximum(sizes, 0))[:-1]) if len(sizes) else sizes
    kept = (sizes == 0) | (sizes > 0) & (wrong == 0)
    coded = kept & (sizes == dims)
    x = values[np.repeat(coded, np.maximum(sizes, 0))].reshape(-1, dims) if dims else np.zeros((int(coded.sum()), 0))
    x = np.floor(SCALE * x)
    if x.size and 4.0 * dims * np.abs(x).max() ** 2 >= 2.0**63:
        raise ValueError("components are too large for exact squared distances")
    return kept, coded, x.astype(np.int64)


def kept(vectors: DataFrame, column: str = "embedding") -> Column:
    """True of rows whose vector has only finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & fine


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Parts of the vectors with the smallest ids; none if there are no vectors."""
    rows = vectors.where(kept(vectors)).select("vec_id", "embedding")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    one = rows.orderBy(*order).limit(1).collect()
    if not one:
        return None
    dims = len(one[0]["embedding"])
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    seeds = rows.where(F.size("embedding") == dims).orderBy(*order).limit(entries).collect()
    x = np.floor(SCALE * np.array([r["embedding"] for r in seeds], float).reshape(len(seeds), dims)).astype(np.int64)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)))


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Entries after one round: floor(sum / count) of the parts that they are nearest to; unused ones stay."""
    parts, entries, size = books.entries.shape
    schema = T.StructType.fromDDL("at int, value long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums = Coder(books), np.zeros((parts, entries, size + 1), np.int64)
        for batch in slices(batches, 4096):
            _, _, x = _integers(batch.column(0), parts * size)
            codes, _ = coder.codes(x)
            for part in range(parts) if len(x) else ():
                order = np.argsort(codes[:, part], kind="stable")
                own, first = np.unique(codes[order, part], return_index=True)
                with_ones = np.column_stack([x[order, part * size : (part + 1) * size], np.ones(len(x), np.int64)])
                sums[part, own] += np.add.reduceat(with_ones, first)
        at = np.nonzero(sums.ravel())[0]
        yield as_batch({"at": at, "value": sums.ravel()[at]}, to_arrow_schema(schema))

    found = vectors.select("embedding").mapInArrow(run, schema).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # parts * entries * (size + 1) at most
    sums = np.zeros((parts * entries * (size + 1)), object)
    for r in found:
        sums[r["at"]] = int(r["value"])
    sums, out = sums.reshape(parts, entries, size + 1), books.entries.copy()
    for part, entry in zip(*np.nonzero(sums[:, :, -1]), strict=True):
        out[part, entry] = [s // sums[part, entry, -1] for s in sums[part, entry, :-1]]
    return Codebooks(out)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, embedding)`` after some rounds; none if there are no vectors."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(vectors, books)
    return books


def code_column(vectors: DataFrame) -> str:
    """The column that ``with_codes`` adds."""
    return free_name(vectors, "coded")


def with_codes(vectors: DataFrame, books: Codebooks | None, column: str = "embedding") -> DataFrame:
    """The kept rows of ``vectors`` with a column of ``code string`` (two hex digits a part) and ``error long``, named by ``code_column``."""
    kind = T.StructType.fromDDL("code string, error long")
    schema = T.StructType([*vectors.schema.fields, T.StructField(code_column(vectors), kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        coder = Coder(books) if books else None
        dims = books.entries.shape[0] * books.entries.shape[2] if books else 0
        for batch in slices(batches, 4096):
            keeps, coded, x = _integers(batch.column(column), dims)
            if not coder:
                continue
            codes, errors = coder.codes(x)
            digits = codes.astype(np.uint8).tobytes().hex()
            width = 2 * codes.shape[1]
            spelt, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            spelt[coded], error[coded] = [digits[k * width : (k + 1) * width] for k in range(len(x))], errors.tolist()
            added = pa.StructArray.from_arrays([pa.array(spelt, pa.string()), pa.array(error, pa.int64())], fields=list(arrow[-1].type))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], schema=arrow).filter(pa.array(keeps))

    return map_whole_rows(vectors, run, schema)


def restored(codes: DataFrame, books: Codebooks, column: str = "code") -> DataFrame:
    """``codes`` with the vector that each code stands for, ``restored array<double>``; null for a null code."""
    width = books.entries.shape[0]
    table = F.lit([[[float(v) / SCALE for v in entry] for entry in book] for book in books.entries.tolist()])
    entry = F.sequence(F.lit(0), F.lit(width - 1))
    number = lambda p: F.conv(F.substring(F.col(column), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("restored", F.when(F.col(column).isNotNull(), F.flatten(F.transform(entry, lambda p: table[p][number(p)]))))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded(label, error, ...)``, a written table, with ``label_error``: the error summed over equal labels, nulls together."""
    by, sums = F.col("label"), coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = written(sums.withColumnRenamed("label", "of_label"))
    often = F.col("n") * HEAVY_LABELS > (sums.agg(F.sum("n")).first()[0] or 0)
    heavy, rare = sums.where(often).drop("n"), sums.where(~often).drop("n")  # heavy: fewer than HEAVY_LABELS rows
    known = coded.join(F.broadcast(heavy.withColumn("is_heavy", F.lit(True))), by.eqNullSafe(F.col("of_label")), "left").drop("of_label")
    rest = known.where(F.col("is_heavy").isNull()).drop("label_error", "is_heavy").join(rare, by.eqNullSafe(F.col("of_label"))).drop("of_label")
    return known.where("is_heavy").drop("is_heavy").unionByName(rest)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = train(vectors)
    coded = with_codes(vectors, books)
    rows = written(coded.select("vec_id", "label", F.col(f"{code_column(vectors)}.code").alias("code"), F.col(f"{code_column(vectors)}.error").alias("error")))
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


QUERIES = {"op12_vector_codes": op12_vector_codes}


def _oracle() -> str:
    assign = """
near{k} as (
  select r, part, min(struct_pack(d := d, idx := idx)) best
  from (select v.r, v.part, b.idx, sum((v.x - b.x) * (v.x - b.x)) d from cells v join book{k} b using (part, pos) group by all) group by all)"""
    move = """
book{j} as (
  select b.part, b.idx, b.pos, coalesce(m.x, b.x) x
  from book{k} b left join (
    select n.part, n.best.idx idx, v.pos, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) x
    from near{k} n join cells v using (r, part) group by n.part, n.best.idx, v.pos) m using (part, idx, pos))"""
    steps = [step.format(k=k, j=k + 1) for k in range(ROUNDS) for step in (assign, move)] + [assign.format(k=ROUNDS)]
    return f"""
with kept as (
  select row_number() over (order by vec_id) r, vec_id, label, embedding from embeddings
  where embedding is not null and (select count(*) from (select unnest(embedding) x) where x is null or not isfinite(x)) = 0),
flat as (select r, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 i, len(embedding) // {PARTS} size from kept),
cells as (select r, i // size part, i % size pos, cast(floor({SCALE} * cast(x as double)) as hugeint) x from flat),
book0 as (select part, r - 1 idx, pos, x from cells where r <= {ENTRIES}),
{",".join(steps)},
spelt as (
  select r, string_agg(printf('%02x', best.idx), '' order by part) code, cast(sum(best.d) as bigint) error from near{ROUNDS} group by r),
books as (select sha256(string_agg(cast(x as varchar), ',' order by part, idx, pos)) codebooks_sha256 from book{ROUNDS}),
labels_ as (select label, cast(sum(error) as bigint) label_error from kept join spelt using (r) group by label)
select k.vec_id, s.code, s.error, l.label_error, b.codebooks_sha256
from kept k join spelt s using (r) join labels_ l on k.label is not distinct from l.label, books b
"""


ORACLE_SQL = {"op12_vector_codes": _oracle()}
