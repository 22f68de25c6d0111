"""Sharding by a permutation-filled lookup table (Maglev hashing).

Shards take turns claiming slots of a prime-sized table, each by its own
preference order, until all are taken. A key's slot, and so its shard, is then
one look into the table, and a change of the shard list moves few keys.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import column

#: The production table: shards and slots, a prime of about 100 slots a shard.
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
TABLE_SIZE = 1609
#: The table is sent to every executor, so its size is bounded: at most 4 MB.
MAX_TABLE_SIZE = 1_000_003


def stable_hash(text: str) -> int:
    """The first 60 bits of the text's MD5, as ``hash_column`` has them."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def hash_column(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 15), 16, 10).cast("long")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position of its shard; every shard has size / n slots, give or take one."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    slot = [stable_hash(f"{s}:offset") % size for s in shards]
    skip = [stable_hash(f"{s}:skip") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for k in range(min(len(shards), left)):
            while owner[slot[k]] >= 0:
                slot[k] = (slot[k] + skip[k]) % size
            owner[slot[k]] = k
            left -= 1
    return owner


def with_shard(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, placed by ``key``; no row is shuffled.

    A null key is placed as the empty one; equal keys always meet in one shard,
    so repeated rows do. Texts, empty or very long, are not looked at. Columns
    named ``slot`` or ``shard`` are replaced. An empty table stays empty.
    """
    spark = df.sparkSession
    owner = F.from_json(F.lit(json.dumps(lookup_table(shards, size))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    slots = spark.range(1).select(F.posexplode(owner).alias("slot", "k")).select("slot", F.element_at(names, F.col("k") + 1).alias("shard"))
    placed = df.drop("slot", "shard").withColumn("slot", F.pmod(hash_column(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int"))
    # left: every slot has a shard, and so the scan's rows are never shuffled
    columns = [column(c) for c in placed.columns if c != "slot"]
    return placed.join(F.broadcast(slots), "slot", "left").select(*columns, "slot", "shard")


def write_shards(df: DataFrame, path: str, files_per_shard: int, key: Column, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> None:
    """One folder of Parquet for each shard, of about ``files_per_shard`` files.

    The rows of a shard are dealt over the files by a hash of the key, so that
    no task has a whole shard.
    """
    placed = with_shard(df, key, shards, size)
    part = F.pmod(F.xxhash64(key, "slot"), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
