"""Greedy paging: dealing ordered keys to pages of limited size.

The cut depends on what the open page holds, and it resets at each cut, so it
is no window function. But a page is closed only after a multiple of
``check_every`` keys: keys are summed in blocks of that many, and where a page
ends at a block, the next end is the first block whose running sum is more by
the limit. So ends are pointers. Ranges of blocks find theirs by binary search
in their own running sums; of pointers that leave a range, the range that they
lead to tells where; these are composed by doubling, which gives the last end
before each range; and by that each range deals its blocks to pages. No task
has more than a range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from folio.sources.scratch import stored

MB = 1024 * 1024
#: Ranges that keys are ranked in at most, the keys of a range before there are more, and the keys that are sampled to cut them.
RANGES = 256
KEYS_PER_RANGE = 100_000
SAMPLED = 20_000
#: Blocks of a range before there are more of them, and pointers from range to range that the driver follows by itself.
BLOCKS_PER_RANGE = 100_000
FOLLOWED = 100_000


@dataclass(frozen=True)
class PageLimits:
    """A page is closed after a key when it has more rows or megabytes than allowed, which is looked at every ``check_every`` keys."""

    max_rows: int | None = None
    max_mb: float | None = None
    check_every: int = 100

    def __post_init__(self) -> None:
        if self.check_every < 1:
            raise ValueError("check_every must be 1 or more")


def row_bytes(schema: StructType) -> int:
    """Bytes of a row in memory: eight for its position and for each column, one for a boolean."""
    return 8 + sum(1 if isinstance(f.dataType, BooleanType) else 8 for f in schema)


def row_limit(limits: PageLimits, bytes_per_row: int) -> float:
    """The number of rows above which a page is closed; infinite without limits."""
    by_rows = float("inf") if limits.max_rows is None else limits.max_rows
    by_size = float("inf") if limits.max_mb is None else limits.max_mb * MB / bytes_per_row
    return min(by_rows, by_size)


def page_ends(rows: np.ndarray, limit: float, every: int, keys_open: int = 0, rows_open: int = 0) -> list[int]:
    """Positions after which a page is closed, for the next keys' row counts and what the open page holds already."""
    ends, start = [], 0
    if not np.isfinite(limit):
        return ends
    total = np.concatenate([[0], np.cumsum(rows)])
    while start < len(rows):
        first = start + (-keys_open - 1) % every  # the next key after which the page is looked at
        if every == 1:  # the sums as they are, so that a page costs a search only
            k = int(np.searchsorted(total, limit + total[start] - rows_open, "right")) - first - 1
            k = max(k, 0)
            if first + k >= len(rows):
                break
        else:
            looked = total[first + 1 :: every] - total[start] + rows_open
            k = int(np.searchsorted(looked, limit, "right"))
            if k == len(looked):
                break
        end = first + k * every
        ends.append(end)
        start, keys_open, rows_open = end + 1, 0, 0
    return ends


def ranked_keys(rows: DataFrame, key_col: str = "key", name: str = "key_ord", ranges: int = RANGES) -> DataFrame:
    """``rows`` with the position of each in order of key, from 0; keys must be distinct and not null.

    Cuts are taken from a sample by hash, so they depend on the keys only and
    every run ranks alike. Each range is sorted by itself and begins where the
    counts of those before it end, so no task has more than a range.
    """
    keys = rows.select(F.col(key_col).cast("string").alias("k"))
    n = keys.count()
    ranges = min(ranges, max(1, n // KEYS_PER_RANGE))
    share = max(1, n // SAMPLED)
    held = [] if ranges == 1 else [r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0).orderBy("k").limit(4 * SAMPLED).collect()]
    cuts = sorted({held[i * len(held) // ranges] for i in range(1, ranges)}) if len(held) >= ranges > 1 else []
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    ranged = rows.withColumn("_range", F.size(F.filter(bounds, lambda c: c <= F.col(key_col).cast("string"))))
    counts = dict(ranged.groupBy("_range").count().collect())  # one for each range
    offsets, at = [], 0
    for i in range(len(cuts) + 1):
        offsets.append(at)
        at += counts.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(x) for x in offsets]).cast("array<bigint>"), F.col("_range") + 1)
    place = F.row_number().over(W.partitionBy("_range").orderBy(F.col(key_col).cast("string")))
    return ranged.withColumn(name, offset + place - 1).drop("_range")


def assign_pages(counts: DataFrame, limits: PageLimits, bytes_per_row: int = 8, key_col: str = "key", rows_col: str = "n_rows", ord_col: str | None = None) -> DataFrame:
    """(key, n_rows, key_ord, page) for one row a key, in order of key from page 0.

    Keys without rows count towards ``check_every`` as others do. The key that
    passes a limit stays in the page it closes. ``ord_col`` has the keys'
    positions from 0 where they are known already.
    """
    limit, every = row_limit(limits, bytes_per_row), limits.check_every
    narrow = [F.col(key_col).cast("string").alias("key"), F.col(rows_col).cast("long").alias("n_rows")]
    # written, as it is read once to count the keys, once for each range's size and once to be ranked
    ranked = counts.select(*narrow, F.col(ord_col).cast("long").alias("key_ord")) if ord_col else ranked_keys(stored(counts.select(*narrow), "keys"))
    if not np.isfinite(limit):
        return ranked.withColumn("page", F.lit(0).cast("long"))
    ranked = ranked.withColumn("_block", F.floor(F.col("key_ord") / every))
    blocks = stored(ranked.groupBy("_block").agg(F.sum("n_rows").alias("n_rows")), "blocks")
    return ranked.join(paged_blocks(blocks, limit), "_block").select("key", "n_rows", "key_ord", "page")


class _Ranges:
    """Ranges of blocks: where each begins and ends in the running sum of all."""

    def __init__(self, totals: list[int], per_range: int, limit: float) -> None:
        self.ends = np.cumsum(np.array(totals, np.int64))
        self.starts = self.ends - np.array(totals, np.int64)
        self.per_range, self.limit = per_range, limit

    def of(self, sums: np.ndarray) -> np.ndarray:
        """The range that the end after one at each of ``sums`` is in; their number if there is none."""
        return np.searchsorted(self.ends, sums + self.limit, "right")

    def sums(self, part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, running sums) of a range, in order."""
        blocks, rows = (np.asarray(part[c], np.int64) for c in ("_block", "n_rows"))
        order = np.argsort(blocks)
        return blocks[order], self.starts[blocks[0] // self.per_range] + np.cumsum(rows[order])

    def after(self, sums: np.ndarray) -> np.ndarray:
        """For an end at each block of a range the position of the next one; their number if it lies beyond."""
        return np.searchsorted(sums, sums + self.limit, "right")


def _leaving(ranges: _Ranges, rows: DataFrame) -> DataFrame:
    """(node, sum, to_range): the blocks of each range that may hold its last end, and the range of the next one."""

    def run(part: pa.Table) -> pa.Table:
        blocks, sums = ranges.sums(part)
        last = ranges.after(sums) == len(sums)
        to = ranges.of(sums[last])
        keep = to < len(ranges.ends)
        return pa.table({"node": blocks[last][keep], "sum": sums[last][keep], "to_range": to[keep].astype(np.int64)})

    return rows.groupBy("_range").applyInArrow(run, "node long, sum long, to_range long")


def _pointers(ranges: _Ranges, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, to, sum, hops): the last end in the range that a node leads to, with its sum, and how many ends that is further."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "to", "sum", "hops")})
        blocks, sums = ranges.sums(own)
        after, here = ranges.after(sums), np.arange(len(sums))
        to, hops = np.where(after < len(sums), after, here), (after < len(sums)).astype(np.int64)
        while True:  # twice as far each time
            further = to[to]
            if (further == to).all():
                break
            hops, to = hops + hops[to], further
        entry = np.searchsorted(sums, np.asarray(asked["sum"], np.int64) + ranges.limit, "right")
        return pa.table({"node": np.asarray(asked["node"], np.int64), "to": blocks[to[entry]], "sum": sums[to[entry]], "hops": hops[entry] + 1})

    return rows.groupBy("_range").cogroup(nodes.groupBy("to_range")).applyInArrow(run, "node long, to long, sum long, hops long")


def _reached(pointers: DataFrame, n_ranges: int) -> list[tuple[int, int, int]]:
    """(block, sum, ends so far) of the last end in each range that has one, from the beginning on; one row for each range at most."""
    if pointers.count() <= FOLLOWED:
        held = {r["node"]: (r["to"], r["sum"], r["hops"]) for r in pointers.collect()}
        found, at, ends = [], -1, 0
        while at in held:
            at, total, hops = held[at]
            ends += hops
            found.append((at, total, ends))
        return found
    jump, far = pointers, 1
    reach = pointers.sparkSession.createDataFrame([(-1, 0, 0)], "node long, sum long, ends long")
    while far <= n_ranges:
        onward = F.broadcast(reach.select("node", "ends")).join(jump, "node")
        reach = stored(reach.unionByName(onward.select(F.col("to").alias("node"), "sum", (F.col("ends") + F.col("hops")).alias("ends"))), "reach")
        twice = jump.select("node", "to", F.col("hops").alias("_h")).join(jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), "sum", "hops"), "to")
        jump, far = stored(twice.select("node", F.col("_to").alias("to"), "sum", (F.col("_h") + F.col("hops")).alias("hops")), "jump"), far * 2
    return sorted((r["node"], r["sum"], r["ends"]) for r in reach.where("node >= 0").collect())


def paged_blocks(blocks: DataFrame, limit: float) -> DataFrame:
    """(_block, page) of a table of (_block, n_rows), whose blocks are numbered from 0 without gaps: a page ends with the block whose rows take it over ``limit``."""
    n = blocks.count()
    n_ranges = min(RANGES, max(1, n // BLOCKS_PER_RANGE))
    per_range = max(1, -(-n // n_ranges))
    if limit < 0:
        return blocks.select("_block", F.col("_block").alias("page"))
    rows = blocks.withColumn("_range", F.floor(F.col("_block") / per_range))
    totals = dict(rows.groupBy("_range").agg(F.sum("n_rows")).collect())  # one for each range
    ranges = _Ranges([totals[r] for r in range(len(totals))], per_range, limit)
    last = []
    if len(totals) > 1:
        first = int(ranges.of(np.zeros(1, np.int64))[0])
        nodes = _leaving(ranges, rows)
        if first < len(totals):
            nodes = nodes.unionByName(blocks.sparkSession.createDataFrame([(-1, 0, first)], nodes.schema))
        last = _reached(stored(_pointers(ranges, rows, nodes), "pointers"), len(totals))
    at = np.array([b for b, _, _ in last], np.int64)
    # what is closed before each range
    before = np.searchsorted(at, np.arange(len(totals)) * per_range)
    closed, pages = (np.concatenate([[0], np.array([x[k] for x in last], np.int64)])[before] for k in (1, 2))

    def deal(part: pa.Table) -> pa.Table:
        own, sums = ranges.sums(part)
        r = own[0] // per_range
        ends = page_ends(np.diff(np.concatenate([[ranges.starts[r]], sums])), limit, 1, 0, int(ranges.starts[r] - closed[r]))
        step = np.zeros(len(own) + 1, np.int64)
        step[np.asarray(ends, np.int64) + 1] = 1
        return pa.table({"_block": own, "page": pages[r] + np.cumsum(step[:-1])})

    return rows.groupBy("_range").applyInArrow(deal, "_block long, page long")


def page_summary(assigned: DataFrame) -> DataFrame:
    """(page, n_keys, n_rows) of an assignment."""
    return assigned.groupBy("page").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))
