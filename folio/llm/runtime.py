"""What the operators share: the session's partitions, the tables, and tables of their own in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.scratch import discard, discard_all, scratch, shared_folder, stored

#: Long keys that are broadcast at most, about 50 MB of them.
BROADCAST_KEYS = 1_000_000

#: Bytes of the batches that texts go to Python in, where the session leaves them as they are by default.
BATCH_BYTES = 2 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

__all__ = ["bounded", "column", "numbered", "discard", "discard_all", "giving_back", "partitions", "scratch", "shared_folder", "small_batches", "stored", "table"]


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, which the caller sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1 and so on, which clash with no name that an operator makes, and the new names by the old ones."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def bounded(keys: DataFrame) -> DataFrame:
    """A ``stored`` table of long keys, to be broadcast if it is known to be small; else it is joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session sends smaller batches to Python from now on, unless a size was set."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: at its end the worker, which stays for later tasks, returns freed memory to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return whole
