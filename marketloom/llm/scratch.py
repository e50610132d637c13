"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where the setting is empty, as in
tests, a folder under the warehouse directory is used and the setting is filled in.

Results are lazy, so what they read stays until the application ends; then, or by ``clear``, all
folders that it made are removed.
"""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def clear() -> None:
    """Remove every folder that ``new_path`` named and that is still there. What was computed
    lazily from them can't be read after that."""
    while _MADE:
        remove(*_MADE.pop())


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear()
    except (Py4JError, OSError):  # the session's gateway is gone before
        _MADE.clear()


#: Step tables of narrow rows are read in partitions of about so many rows.
STEP_ROWS = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` narrow rows, in as few partitions as they need. One partition
    is enough for few rows, and what follows then needs no shuffle."""
    return df.coalesce(rows // STEP_ROWS + 1)


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    return _write(df, label)[0]


class Steps:
    """The step tables of one job. A table is dropped when all that was made of it is written."""

    def __init__(self) -> None:
        self._tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """As ``write_through``."""
        self._tables.append(_write(df, label))
        return self._tables[-1][0]

    def write_narrow(self, df: DataFrame, label: str) -> tuple[DataFrame, int]:
        """A table of narrow rows, ``packed``, and its number of rows."""
        out, path = _write(df, label)
        rows = out.count()
        self._tables.append((packed(out, rows), path))
        return self._tables[-1][0], rows

    def drop(self, df: DataFrame) -> None:
        """Remove the table behind ``df``."""
        for table, path in [t for t in self._tables if t[0] is df]:
            remove(table.sparkSession, path)
        self._tables = [t for t in self._tables if t[0] is not df]

    def drop_all(self) -> None:
        for table, path in self._tables:
            remove(table.sparkSession, path)
        self._tables = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
