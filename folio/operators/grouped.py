"""A user's function over all channels of a key, in one exchange and bounded memory.

The channels are united as one frame, each row with the number of its channel
and its columns as a struct, dealt out by key and sorted by key, channel and
the order that the caller asks for. Tasks read this as a stream: a key's
channels come one after the other in pieces, so that a key with very many rows
is never held whole unless the function does it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

#: A key's channels as pieces: names in the order of the mapping, each with as many pieces as its rows take, or none.
Pieces = Iterator[tuple[str, pd.DataFrame]]
Streamed = Callable[[str, Pieces], Iterator[pd.DataFrame]]
Whole = Callable[[dict[str, pd.DataFrame]], pd.DataFrame | None]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tagged_union(channels: Mapping[str, DataFrame], keys: DataFrame | None = None, key_col: str = "key", order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(key, tag, c0, c1, ...): all rows of all channels in one frame, dealt out by key and sorted by key and channel.

    ``tag`` is the channel's number, and the columns of its rows are the struct
    of that number. ``keys`` adds a row of tag -1 for each of its keys, so that
    keys without rows in any channel are there. ``order`` names columns of a
    channel by which its rows are sorted within a key. Rows without a key are
    left out.
    """
    frames = list(channels.items())
    if not frames:
        raise ValueError("no channels to unite")
    if unknown := set(order or {}) - set(channels):
        raise ValueError(f"order of the unknown channels {sorted(unknown)}")
    structs = [df.drop(key_col).schema for _, df in frames]

    def row(df: DataFrame, tag: int) -> DataFrame:
        own = [F.struct(*[F.col(_quoted(c)) for c in structs[tag].names]) if k == tag and structs[k].names else F.lit(None).cast(structs[k]) for k in range(len(frames))]
        return df.select(F.col(_quoted(key_col)).cast("string").alias("key"), F.lit(tag).alias("tag"), *[c.alias(f"c{k}") for k, c in enumerate(own)])

    parts = [row(df, tag) for tag, (_, df) in enumerate(frames)]
    if keys is not None:
        parts.append(row(keys.select(key_col).distinct(), -1))
    united = reduce(DataFrame.unionAll, parts).where("key is not null")
    sorts = [F.col(f"c{tag}").getField(c) for tag, (name, _) in enumerate(frames) for c in (order or {}).get(name, ())]
    return united.repartition("key").sortWithinPartitions("key", "tag", *sorts)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(key, tag, rows) of every run of a key and channel, batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, tags = batch["key"].dictionary_encode(), np.asarray(batch["tag"])
        code = np.asarray(keys.indices)
        starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (tags[1:] != tags[:-1])]))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            yield keys.dictionary[int(code[a])].as_py(), int(tags[a]), batch.slice(a, b - a)


def _as_pandas(columns: pa.StructArray, kinds: pa.Schema, zone: str) -> pd.DataFrame:
    if not kinds.names:
        return pd.DataFrame(index=range(len(columns)))
    frame = pa.Table.from_arrays(columns.flatten(), schema=kinds).to_pandas()
    for name in frame.columns[[isinstance(t, pd.DatetimeTZDtype) for t in frame.dtypes]]:
        frame[name] = frame[name].dt.tz_convert(zone).dt.tz_localize(None)
    return frame


def streamed_by_key(function: Streamed, channels: Mapping[str, DataFrame], schema: StructType | str, keys: DataFrame | None = None, key_col: str = "key", order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The rows that ``function`` gives for each key, with its ``key``.

    The function is called once a key with the key and an iterator of pieces
    (channel, pandas rows); what it does not read is skipped. It gives an
    iterator of frames of ``schema``, none of them if the key has no result.
    A column of the schema that is named as the key's gets the key.
    """
    united = tagged_union(channels, keys, key_col, order)
    names = list(channels)
    spark = united.sparkSession
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = StructType([f for f in made if f.name != key_col]).add(key_col, StringType())
    zone = spark.conf.get("spark.sql.session.timeZone")
    arrow = to_arrow_schema(made)
    # what Arrow calls the columns of each channel
    kinds = [to_arrow_schema(df.drop(key_col).schema) for df in channels.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(_pieces(batches), key=lambda p: p[0]):
            pieces = ((names[tag], _as_pandas(rows.column(f"c{tag}"), _typed(rows, tag, kinds[tag]), zone)) for _, tag, rows in own if tag >= 0)
            for frame in function(key, pieces):
                if len(frame):
                    frame = frame.assign(**{key_col: key})[made.names]
                    for f in arrow:
                        if pa.types.is_timestamp(f.type) and f.type.tz and frame[f.name].dt.tz is None:
                            frame[f.name] = frame[f.name].dt.tz_localize(zone)
                    yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return united.mapInArrow(run, made)


def _typed(rows: pa.RecordBatch, tag: int, kinds: pa.Schema) -> pa.Schema:
    """The channel's columns as they came, which may differ from the plan's in how texts are stored."""
    kind = rows.schema.field(f"c{tag}").type
    return pa.schema([pa.field(name, kind.field(i).type) for i, name in enumerate(kinds.names)])


def by_key(function: Whole, channels: Mapping[str, DataFrame], schema: StructType | str, keys: DataFrame | None = None, key_col: str = "key", order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The rows that ``function`` gives for all channels of each key: frames by channel, those without rows empty.

    A key's rows are held together, one key at a time; ``streamed_by_key`` is
    for keys that are too large for it. None and empty frames are no rows.
    """
    empty = {name: to_arrow_schema(df.drop(key_col).schema).empty_table().to_pandas() for name, df in channels.items()}

    def whole(key: str, pieces: Pieces) -> Iterator[pd.DataFrame]:
        held: dict[str, list[pd.DataFrame]] = {}
        for name, rows in pieces:
            held.setdefault(name, []).append(rows)
        got = {name: pd.concat([x.assign(**{key_col: key}) for x in held[name]], ignore_index=True) if name in held else none.assign(**{key_col: pd.Series(dtype=str)}) for name, none in empty.items()}
        made = function(got)
        if made is not None:
            yield made

    return streamed_by_key(whole, channels, schema, keys, key_col, order)

