"""Intermediate tables that survive the loss of executors.

A loop or a table read twice is cut off from its lineage by writing it as Parquet below the
session's checkpoint folder, which every executor of a cluster shares.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_names: dict[str, str] = {}
_once: dict[tuple, DataFrame] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder and return the table read back."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """As ``written``, in as many buckets by ``keys`` as a shuffle has partitions: joins and sums by just these keys read it without a shuffle.

    ``dealt`` says that ``df`` comes out of such a join or sum, so that its rows needn't be dealt by the keys first.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"table_{uuid.uuid4().hex}"
    path = f"{scratch_folder(spark)}/table-{name[6:]}"
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    _written.append((spark, path))
    _names[path] = name
    return spark.table(name)


def written_once(spark: SparkSession, make: Callable[[], DataFrame], *key: object, by: tuple[str, ...] = ()) -> DataFrame:
    """The table that ``make`` gives, written (in buckets, if ``by`` names columns) when an application first asks for it under ``key``; ``drop_written`` forgets it."""
    return made_once(spark, lambda: written_by(make(), *by) if by else written(make()), *key)


def made_once(spark: SparkSession, make: Callable[[], DataFrame], *key: object) -> DataFrame:
    """As ``written_once``, but nothing is written: for what its readers had better make again."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _once:
        _once[key] = make()
    return _once[key]


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` has returned and that nothing reads any more, such as those of a loop's former rounds."""
    for table in tables:
        files = {f.rsplit("/", 1)[0] for f in table.inputFiles()} if table is not None else set()
        for k, (spark, path) in reversed(list(enumerate(_written))):
            if any(f.endswith(path.rsplit("/", 1)[1]) for f in files):
                _delete(spark, path)
                del _written[k]


def _delete(spark: SparkSession, path: str) -> None:
    if name := _names.pop(path, None):
        spark.sql(f"drop table if exists {name}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` has left; what was derived from them can't be read afterwards."""
    for _, path in _written:
        _delete(spark, path)
    _written.clear()
    _once.clear()


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if _written and (spark := SparkSession.getActiveSession()) is not None:
            drop_written(spark)
