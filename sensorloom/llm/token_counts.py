"""Token counts from an exact length histogram.

Documents are aggregated by encoded length, once. Everything else is a sum over the histogram: with the
documents and tokens at and above each length known, totals, quantiles and the tokens left after cutting
at any context limit follow without another look at a text.

Null and empty texts have length 0, very long ones are encoded whole. Repeated rows count as often as they occur; documents of equal
length share a row. An empty table gives an
empty histogram. Other columns than ``text`` are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.batches import map_batches
from sensorloom.llm.tokens import Vocabulary
from sensorloom.plans.scratch import written

#: Lengths of one bucket of the two-level suffix sums.
BUCKET = 256


def length_histogram(docs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``length long, n_documents long``: how many documents have each encoded length."""

    def make():
        encoder = vocabulary.encoder()
        return lambda batch: {"length": [encoder.count(t) for t in batch.column(0).to_pylist()]}

    return map_batches(docs.select(F.col("text").cast("string")), make, "length long").groupBy("length").agg(F.count(F.lit(1)).alias("n_documents"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs, taken as context limit.

    ``n_longer``: documents over the limit; ``tokens_total``: tokens of all documents;
    ``tokens_kept``: tokens when each document is cut at the limit; ``tokens_cut``: the rest;
    ``share_within``: share of documents that fit whole, the quantile rank of the length.
    Between two lengths that occur, ``tokens_kept`` is linear, with slope ``n_longer``. The histogram is read
    twice: give a written one.
    """
    # The sums run within buckets of lengths and over the buckets, in one task: those are at most (longest length) / BUCKET rows, 40,000 for
    # a text of ten million tokens, however many documents there are.
    h = histogram.withColumn("bucket", F.floor(F.col("length") / BUCKET))
    sums = h.groupBy("bucket").agg(F.sum("n_documents").alias("bucket_docs"), F.sum(F.col("n_documents") * F.col("length")).alias("bucket_tokens"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "bucket",
        F.coalesce(F.sum("bucket_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("bucket_docs").over(whole).alias("docs_total"),
        F.sum("bucket_tokens").over(whole).alias("tokens_total"),
    )
    upto = Window.partitionBy("bucket").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    docs = F.col("docs_before") + F.sum("n_documents").over(upto)
    tokens = F.col("tokens_before") + F.sum(F.col("n_documents") * F.col("length")).over(upto)
    out = h.join(sums, "bucket").withColumn("docs_upto", docs).withColumn("tokens_upto", tokens)
    kept = F.col("tokens_upto") + F.col("length") * (F.col("docs_total") - F.col("docs_upto"))
    return out.select(
        F.col("length").alias("context_limit"),
        "n_documents",
        (F.col("docs_total") - F.col("docs_upto")).alias("n_longer"),
        "tokens_total",
        kept.alias("tokens_kept"),
        (F.col("tokens_total") - kept).alias("tokens_cut"),
        (F.col("docs_upto") / F.col("docs_total")).alias("share_within"),
    )


def totals_at(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: documents, those longer, tokens, tokens kept."""
    cut = F.least(F.col("length"), F.lit(limit))
    return histogram.agg(
        F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"),
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_documents"))), F.lit(0)).alias("n_longer"),
        F.coalesce(F.sum(F.col("n_documents") * F.col("length")), F.lit(0)).alias("tokens_total"),
        F.coalesce(F.sum(F.col("n_documents") * cut), F.lit(0)).alias("tokens_kept"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length within which a share ``q`` of the documents fits; null on an empty histogram."""
    return limits.where(F.col("share_within") >= q).agg(F.min("context_limit").alias("length"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All context limits over all of ``documents``."""
    return context_limits(written(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE_SQL: dict[str, str] = {}
