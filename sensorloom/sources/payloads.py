"""Landed API payloads, one JSON file or line for each day, and checks of what was collected."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.grid import HOURS

_ITEM = "struct<statDate:string,linkID:string," + ",".join(f"{h}:double" for h in HOURS) + ",seq:long>"
SCHEMA = f"day string, response struct<header:struct<resultCode:string>,body:struct<items:array<{_ITEM}>>>"
#: The code of a good answer, and the rows that one answer holds at most.
GOOD, MOST_ROWS = "00", 5000


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with their day."""
    return spark.read.schema(SCHEMA).json(path)


def payload_rows(payloads: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """Rows of all days. An empty day is skipped or, without ``ignore_empty``, an error; odd codes and long answers only warn."""
    status = payload_status(payloads)
    odd = status.agg(F.count_if("is_empty").alias("empty"), F.count_if(F.col("result_code") != GOOD).alias("odd"), F.count_if("is_over").alias("over")).first()
    if odd["empty"] and not ignore_empty:
        raise ValueError(f"{odd['empty']} days have no rows")
    if odd["odd"] or odd["over"]:
        warnings.warn(f"{odd['odd']} answers with another code than {GOOD}, {odd['over']} of more than {MOST_ROWS} rows", stacklevel=2)
    return payloads.select(F.explode("response.body.items").alias("r")).select("r.*")


def payload_status(payloads: DataFrame) -> DataFrame:
    """``day, result_code, n_rows, is_empty, is_over`` for each payload."""
    n = F.coalesce(F.size("response.body.items"), F.lit(0))
    n = F.greatest(n, F.lit(0)).cast("long")
    return payloads.select("day", F.col("response.header.resultCode").alias("result_code"), n.alias("n_rows"), (n == 0).alias("is_empty"), (n > MOST_ROWS).alias("is_over"))


def check_date_range(raw: DataFrame, start: str, end: str) -> DataFrame:
    """``first_date, last_date``, or an error if they aren't the given ones."""
    found = raw.agg(F.min("statDate").alias("first_date"), F.max("statDate").alias("last_date"))
    got = found.first()
    if (got["first_date"], got["last_date"]) != (start, end):
        raise ValueError(f"rows from {got['first_date']} to {got['last_date']}, wanted {start} to {end}")
    return found
