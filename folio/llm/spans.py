"""Words of Arrow string columns and hashes of their runs, in little memory; packed exchanges of what is found in them.

Words are hashed eight bytes at a time, so that memory is some twelve bytes a
byte of the block or of the longest text. A packed exchange sends one row for
each slice of documents and each shard; its entries are numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from folio.llm.runtime import column, giving_back
from folio.llm.words import Words, mix, prefix_sums, span_hashes, words

#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word of ``data``."""
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = ends - starts
    out = size.astype(np.uint64) * _STEP
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = ends[live] - at
        out[live] = mix(out[live] ^ (eight[at] & _LOW[np.minimum(left, 8)])) * _STEP
        on = (left > 8) & (size[live] <= LONG_WORD)
        live, at = live[on], at[on] + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return mix(out)


def hashed_words(column: pa.Array, **kw) -> Iterator[Words]:
    """``words`` of a column with the hashes of this module."""
    for w in words(column, hashed=False, **kw):
        w.hashes = word_hashes(w.data, w.starts, w.ends)
        yield w


class Runs:
    """Hashes of runs of words of a block: of 64 bits, and others by which runs are dealt out."""

    def __init__(self, w: Words):
        self.total = prefix_sums(w.hashes)
        self.other = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hashes ^ _STEP), dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, k: int) -> np.ndarray:
        return span_hashes(self.total, starts, starts + k)

    def deal(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Independent of ``hashes``: two runs are taken for equal only if both agree as far as they are used."""
        return mix(self.other[starts + k] - self.other[starts])


def whole_number(df: DataFrame, name: str) -> Column:
    """The column as long; a column of another type than an integer one is refused, as ids are compared by value."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{name} must be of an integer type, not {kind.simpleString()}")
    return column(name).cast("long")


def by_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): rows of the same id and text share a key, which a task that runs again gives them again."""
    id_, text = whole_number(docs, id_col), column(text_col).cast("string")
    return docs.select(F.xxhash64(id_.isNull(), id_, text).alias("key"), id_.alias("id"), text.alias("text"))


def dealt(parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds) that bring the entries of each part together, each in the order given."""
    order = np.argsort(parts.astype(np.uint16) if n <= 1 << 16 else parts, kind="stable")  # of 16 bits numpy's is a radix sort
    return order, np.concatenate([[0], np.cumsum(np.bincount(parts, minlength=n))])


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one body, which ``unpacked`` takes apart again given their types."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpacked(body: pa.Buffer | bytes, *types: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(body, np.int64, len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(body, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_SENT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("body", pa.binary())])
SENT_DDL = "part int, kind byte, body binary"


def sent(rows: Iterator[tuple[int, int, bytes]], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of (part, kind, body) of about ``size`` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[2])
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _SENT, strict=True)], schema=_SENT)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _SENT, strict=True)], schema=_SENT)


#: Parts that rows are dealt to in one exchange at most; more are reached in two, so that the number of rows grows with
#: what is sent and not with the parts times that.
FAN = 1_024
#: Bytes that a task holds until it sends them on to all groups of parts.
HELD = 16 << 20
_CONTAINER = 1 << 6


def _contained(rows: list[tuple[int, int, bytes]]) -> bytes:
    """Rows of (part, kind, body) as one body."""
    return packed(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int8), np.array([len(r[2]) for r in rows], np.int64)) + b"".join(r[2] for r in rows)


def _opened(body: pa.Buffer) -> Iterator[tuple[int, int, pa.Buffer]]:
    parts, kinds, sizes = unpacked(body, np.int64, np.int8, np.int64)
    at = 24 + 17 * len(parts)
    for part, kind, size in zip(parts.tolist(), kinds.tolist(), sizes.tolist(), strict=True):
        yield part, kind, body.slice(at, size)
        at += size


def _grouped(rows: Iterator[tuple[int, int, bytes]], group: Callable[[int], int]) -> Iterator[tuple[int, int, bytes]]:
    """(group, kind of a container, rows of the group as one body), some megabytes of all groups at a time."""
    held: dict[int, list] = {}
    weight = 0
    for row in rows:
        held.setdefault(group(row[0]), []).append(row)
        weight += len(row[2])
        if weight >= HELD:
            yield from ((g, _CONTAINER, _contained(x)) for g, x in held.items())
            held, weight = {}, 0
    yield from ((g, _CONTAINER, _contained(x)) for g, x in held.items())


def exchanged(df: DataFrame, send: Callable, parts: int) -> DataFrame:
    """What ``send`` makes of the batches of ``df``, each part in a partition of its own.

    To more than ``FAN`` parts rows go by way of groups of parts, first to a
    task for each group, which sends the rows of each of its parts together.
    """
    if parts <= FAN:
        return df.mapInArrow(giving_back(lambda batches: sent(send(batches))), SENT_DDL).repartitionById(parts, "part")
    width = -(-parts // FAN)
    groups = -(-parts // width)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for body in batch["body"] for row in _opened(body.as_buffer()))
        yield from sent(_grouped(((p, k, x.to_pybytes()) for p, k, x in rows), lambda part: part))

    first = df.mapInArrow(giving_back(lambda batches: sent(_grouped(send(batches), lambda part: part // width))), SENT_DDL).repartitionById(groups, "part")
    return first.mapInArrow(giving_back(again), SENT_DDL).repartitionById(parts, "part")


def bodies(batches: Iterator[pa.RecordBatch]) -> dict[int, list[pa.Buffer]]:
    """The bodies of a part by their kind."""
    out: dict[int, list] = {}
    for batch in batches:
        for kind, body in zip(batch["kind"].to_pylist(), batch["body"], strict=True):
            for _, k, x in _opened(body.as_buffer()) if kind == _CONTAINER else [(0, kind, body.as_buffer())]:
                out.setdefault(k, []).append(x)
    return out
