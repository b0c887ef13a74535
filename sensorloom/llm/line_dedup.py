"""Removal of lines that many documents share.

1. Each document is exploded into its distinct normalised lines, each a 128-bit hash.
2. Documents are counted by hash; hashes of at least ``min_docs`` documents are over the threshold.
3. Lines over the threshold are dropped from every document but the smallest ``doc_id`` that holds them.
4. The rest is reassembled by position.

Lines are hashed once, into a written table. A line that a third of all documents hold is summed in each task before the shuffle; where
its rows meet the counts, hashes that over a ``HEAVY``-th of all lines have are dealt to as many parts as they have such shares. There are
fewer than ``HEAVY`` of them, whatever the corpus, so their list is broadcast. Texts are shuffled once, to meet their document's list of dropped lines.

Rows with one ``doc_id`` are one document, repeated rows too. A null ``doc_id`` is a document that comes after all others. Null
or empty text is one empty line. Very long texts are split whole; a document's list of dropped lines is never longer than its text has lines. An
empty table gives an empty result. Other columns pass through, whatever their names: counts go to one struct column with a free name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.batches import as_batch, free_name, id_and_text, map_batches, map_whole_rows, slices
from sensorloom.plans.scratch import written

#: Hashes with more than this share, 1 / HEAVY, of all lines are split.
HEAVY = 5000
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case; other letters stay."""
    return line.strip(_SPACE).lower()


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None for keys too short to count."""
    key = line_key(line)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def hashed_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``doc_id, hi, lo``: the distinct lines of each document that are long enough."""

    def make():
        def explode(batch: pa.RecordBatch) -> dict:
            digests, counts = [], []
            for text in batch.column(1).to_pylist():
                own = {h for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if (h := key_hash(line, min_chars)) is not None}
                digests += own
                counts.append(len(own))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = np.repeat(np.arange(batch.num_rows), counts)
            return {"doc_id": batch.column(0).take(pa.array(rows)), "hi": halves[:, 0], "lo": halves[:, 1]}

        return explode

    return map_batches(id_and_text(docs), make, "doc_id long, hi long, lo long")


def shared_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """``hi, lo, keeper, n``: hashes of at least ``min_docs`` documents, the first that holds them, and their rows in ``lines``."""
    if min_docs == 2:  # two documents differ exactly if the least and the greatest do; this combines before the shuffle
        n = F.when(F.min("doc_id") < F.max("doc_id"), 2).otherwise(1) + F.when(F.bool_or(F.col("doc_id").isNull()) & F.min("doc_id").isNotNull(), 1).otherwise(0)
    else:
        lines = lines.distinct()
        n = F.count(F.lit(1))
    return lines.groupBy("hi", "lo").agg(F.min("doc_id").alias("keeper"), n.alias("n_docs"), F.count(F.lit(1)).alias("n")).where(F.col("n_docs") >= min_docs).drop("n_docs")


def dropped_lines(lines: DataFrame, shared: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, dropped array<struct<hi, lo>>``: for each document that loses lines, their hashes."""
    share = lines.count() // heavy + 1
    split = F.broadcast(shared.where(F.col("n") > share).select("hi", "lo", F.ceil(F.col("n") / share).cast("long").alias("parts")))  # fewer than ``heavy`` rows
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    lines = lines.join(split, ["hi", "lo"], "left").select("doc_id", "hi", "lo", F.pmod(F.xxhash64("doc_id"), parts).alias("part"))
    shared = shared.join(split, ["hi", "lo"], "left").select("hi", "lo", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    lost = lines.join(shared, ["hi", "lo", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("dropped"))


def lines_column(docs: DataFrame) -> str:
    """The name of the column that ``dedup_lines`` adds to ``docs``."""
    return free_name(docs, "lines")


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with its text reassembled, and a struct column named ``lines_column(docs)``: ``n_lines`` (before) and ``n_dropped``."""
    name, by, dropped = lines_column(docs), free_name(docs, "lost_by"), free_name(docs, "lost")
    lines = written(hashed_lines(docs, min_chars))
    lost = dropped_lines(lines, written(shared_lines(lines, min_docs))).select(F.col("doc_id").alias(by), F.col("dropped").alias(dropped))
    joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(by)), "left").drop(by)
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in joined.schema if f.name != dropped]).add(name, T.StructType().add("n_lines", "long").add("n_dropped", "long"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in slices(batches):
            out = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            texts, counts = [], []
            for text, lost in zip(out["text"].cast(pa.string()).to_pylist(), out.pop(dropped).to_pylist(), strict=True):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                before = len(lines)
                if lost:
                    gone = {np.array([x["hi"], x["lo"]], "<i8").tobytes() for x in lost}
                    lines = [line for line in lines if key_hash(line, min_chars) not in gone]
                    text = b"\n".join(lines).decode("utf-8", "surrogatepass")
                texts.append(text)
                counts.append({"n_lines": before, "n_dropped": before - len(lines)})
            yield as_batch(out | {"text": texts, name: counts}, arrow)

    return map_whole_rows(joined, run, schema)


def sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all ``documents`` that another document holds too."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL = {
    "op2_line_dedup": r"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
lines as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos from split),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
shared as (
  select k, min(doc_id) keeper from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
flagged as (
  select doc_id, pos, line, (keeper is not null and keeper <> doc_id) gone from keyed left join shared using (k))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from flagged group by doc_id
"""
}
