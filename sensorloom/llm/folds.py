"""Which labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True of the fifth of the ids whose labels are never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` (0 or 1) of the rows to learn from, one for each id; rows that disagree are left out."""
    rows = labels.where(~held_out() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    one = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return one.where(F.col("label") == F.col("most")).select("doc_id", "label")


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each label, the first by a hash of the id."""
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(k)), "doc_id").limit(most) for k in (0, 1)]
    return parts[0].union(parts[1])
