"""From raw documents to packed training sequences: five stages, each a Spark job on what the one before has kept.

All stages but the last return the columns of ``documents``, in their order and with their types; columns beyond ``doc_id``, ``text`` and
``n_chars`` pass through unread, whatever their names (results travel in columns with free names, or in none). ``n_chars`` is counted anew from the
text a stage leaves.

* Null and empty texts are not toxic, have one empty line, no words and no leaks, and pack as one end id. Equal texts without words, which line
  dedup may leave, are near-duplicates of each other; one stays.
* Very long texts are read whole by every stage.
* Repeated rows are scored each, count as one document in line dedup, and are near-duplicates of each other; one stays.
* Ties: a shared line stays in the smallest ``doc_id``; of a group of near-duplicates the smallest ``doc_id`` stays, a null one last, then the
  row that is read first.
* An empty table gives an empty result at every stage, an empty benchmark removes nothing, and without labels nothing is toxic.

Line dedup comes before near-dedup, in the order asked for. So a later copy has lost what lines it shares with an earlier one, often all, before near-dedup
looks at it: exact copies are then equal texts without words, or copies of what is left, and near copies that differ in a few lines are
left with those lines only, which are no near-duplicates any more. README has the figures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from sensorloom.plans.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _same_columns(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` in the columns of ``docs``, with ``n_chars``, if there, counted anew (null for a null text)."""
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return found.select(*[counted.get(c, F.col(f"`{c}`")) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _same_columns(docs, toxicity.with_scores(docs, model).where(F.col(toxicity.score_column(docs)) < 0.5))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds."""
    return _same_columns(docs, line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that were nothing else go."""
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _same_columns(docs, decontamination.remove_spans(leaks, decontamination.leaks_column(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
