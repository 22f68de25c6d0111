"""Tables in the folder that all executors share: how lineage is cut on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, which ``discard_all`` removes."""
    path = f"{shared_folder(spark)}/folio-{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back.

    A lost executor loses no part of the table, and what reads it does not
    recompute what made it. ``discard`` removes it; what the caller's result
    still reads stays until ``discard_all``, or until the ``scratch`` ends that
    it was made in.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folio_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _stored.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes ``stored`` tables that nothing reads any more."""
    for t in tables:
        if t._folio_path in _stored:
            _delete(t.sparkSession, t._folio_path)


def discard_all(spark: SparkSession) -> None:
    """Removes every table that this process has stored: for when its results are written."""
    for path in list(_stored):
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Removes, when it ends, what was stored within, but for the tables that are in ``keep`` by then."""
    before = set(_stored)
    yield
    wanted = before | {t._folio_path for t in keep}
    for path in [p for p in _stored if p not in wanted]:
        _delete(spark, path)
