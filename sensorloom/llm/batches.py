"""Arrow batches in, Arrow batches out: the frame around the small Python helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Helper = Callable[[pa.RecordBatch], dict]


#: Rows that a helper sees at once; their texts are Python objects meanwhile.
SLICE_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, without empty ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts in ``column`` have at most ``most`` bytes together, or one row with more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def map_whole_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any names, also those with dots."""
    given, got = df.columns, [f.name for f in schema]
    plain = [f"_{k}" for k in range(max(len(given), len(got)))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(given) for b in batches):
            yield batch.rename_columns(plain[: len(got)])

    fields = T.StructType([T.StructField(name, f.dataType) for name, f in zip(plain, schema, strict=False)])
    return df.toDF(*plain[: len(given)]).mapInArrow(renamed, fields).toDF(*got)


def map_batches(df: DataFrame, make: Callable[[], Helper], schema: str | T.StructType) -> DataFrame:
    """Run ``make()`` once in each task and its result on slices of the batches of ``df``.

    The helper returns a dict from the columns of ``schema`` to lists or arrays of equal length.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        helper, arrow = make(), to_arrow_schema(schema)
        for batch in slices(batches):
            yield as_batch(helper(batch), arrow)

    return df.mapInArrow(run, schema)


def summed(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], size: int) -> np.ndarray:
    """The sum over all batches of vectors of a fixed ``size``; each task sends one vector to the shuffle."""
    schema = T.StructType.fromDDL("at long, value double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        helper, total = make(), np.zeros(size)
        for batch in slices(batches, 8 * SLICE_ROWS):
            total += helper(batch)
        at = np.nonzero(total)[0]
        yield as_batch({"at": at, "value": total[at]}, to_arrow_schema(schema))

    found = df.mapInArrow(run, schema).groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    """A record batch of ``arrow``'s fields."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in arrow], schema=arrow)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so that other columns of the caller can't clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores after it as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(texts: list[str | None]) -> list[bytes]:
    """The bytes of each text; null becomes empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def lengths_to_offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each part and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
