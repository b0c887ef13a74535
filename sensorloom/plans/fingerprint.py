"""A table's content as one number that doesn't depend on the order of its rows, and the same in SQL.

Each row is a text of its columns, whose hash is a whole number; the fingerprint is their sum, so that a repeated, missing or changed row moves it, and
tasks add up their own rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal digits to which doubles are compared.
DIGITS = 6


def _text(column: str, kind: str) -> Column:
    value = F.col(column)
    if kind == "double":
        value = F.round(value * 10**DIGITS).cast("long")
    return F.coalesce(value.cast("string"), F.lit("~"))


def fingerprint(table: DataFrame) -> DataFrame:
    """``n_rows long, digest string`` of a table of strings, whole numbers, booleans and doubles; columns count in the order of their names."""
    parts = [_text(c, kind) for c, kind in sorted(table.dtypes)]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def fingerprint_sql(table: str, kinds: Mapping[str, str]) -> str:
    """The same as a DuckDB query over ``table``; ``kinds``: for each column that counts whether it is a ``double`` or anything else."""
    parts = [f"coalesce(cast({f'cast(round({c} * {10**DIGITS}) as bigint)' if kind == 'double' else c} as varchar), '~')" for c, kind in sorted(kinds.items(), key=lambda x: x[0].strip('"'))]
    return f"select count(*) n_rows, cast(coalesce(sum(cast('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 15) as bigint)), 0) as varchar) digest from {table}"
