"""Unions by name, key differences and counts of keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there.

    Numbers widen. Columns of other types that differ are rejected when the
    plan is made, instead of failing on a value later.
    """
    if not frames:
        raise ValueError("no frames to unite")
    kinds: dict[str, object] = {}
    for f in (field for df in frames for field in df.schema):
        held = kinds.setdefault(f.name, f.dataType)
        if held != f.dataType and not (isinstance(held, NumericType) and isinstance(f.dataType, NumericType)):
            raise TypeError(f"column {f.name} is {held.simpleString()} in one frame and {f.dataType.simpleString()} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def remaining_keys(keys: DataFrame, done: DataFrame, key_col: str = "key") -> DataFrame:
    """The distinct keys that are not done."""
    return keys.select(key_col).subtract(done.select(key_col))


def rows_per_key(keys: DataFrame, rows: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, n_rows) of every distinct key, those without rows included."""
    counted = rows.groupBy(key_col).agg(F.count("*").alias("n_rows"))
    return keys.select(key_col).distinct().join(counted, key_col, "left").select(key_col, F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))
