"""Schemas of many Parquet files: read from their footers by tasks, and folded into one that all of them widen to."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StructField, StructType

from folio.errors import ChannelError

#: Fixed value: where Spark keeps the schema of a file that it wrote.
_OWN = b"org.apache.spark.sql.parquet.row.metadata"
#: Digits that integers take, by their bytes.
_DIGITS = {1: 3, 2: 5, 4: 10, 8: 19}


def footers(files: DataFrame, base: str, path_col: str = "path_key") -> DataFrame:
    """(path_key, schema, rows) of the files below ``base``: schemas as JSON, null where there is none or no file system of Arrow's reads it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None
        for batch in batches:
            out = []
            for key in batch[path_col]:
                path = f"{base}/{key}"
                try:
                    if known is None:
                        known = fs.FileSystem.from_uri(path)[0] if ":/" in path else fs.LocalFileSystem()
                    place = fs.FileSystem.from_uri(path)[1] if ":/" in path else path
                    with known.open_input_file(place) as f:
                        footer = pq.ParquetFile(f)
                        own = (footer.metadata.metadata or {}).get(_OWN)
                        schema = own.decode() if own else from_arrow_schema(footer.schema_arrow, prefer_timestamp_ntz=True).json()
                        out.append((key, schema, footer.metadata.num_rows))
                except (OSError, ValueError, NotImplementedError):
                    out.append((key, None, None))
            yield pd.DataFrame(out, columns=["path_key", "schema", "n_rows"]).astype({"n_rows": "Int64"})

    return files.select(path_col).mapInPandas(read, "path_key string, schema string, n_rows long")


def wider(a: DataType, b: DataType, name: str = "") -> DataType:
    """The narrowest type that both widen to without loss of what either can hold in whole numbers of its range; else a ChannelError."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    integers = isinstance(a, IntegralType), isinstance(b, IntegralType)
    if all(integers):
        return max(a, b, key=_bytes_of)
    if isinstance(a, (FloatType, DoubleType, DecimalType, IntegralType)) and isinstance(b, (FloatType, DoubleType, DecimalType, IntegralType)):
        if isinstance(a, (FloatType, DoubleType)) or isinstance(b, (FloatType, DoubleType)):
            return DoubleType()
        p, q = _as_decimal(a), _as_decimal(b)
        scale = max(p.scale, q.scale)
        digits = max(p.precision - p.scale, q.precision - q.scale) + scale
        if digits <= 38:
            return DecimalType(digits, scale)
    if isinstance(a, StructType) and isinstance(b, StructType):
        return folded([a, b], name)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(wider(a.elementType, b.elementType, f"{name}[]"))
    if isinstance(a, MapType) and isinstance(b, MapType) and a.keyType == b.keyType:
        return MapType(a.keyType, wider(a.valueType, b.valueType, f"{name}[]"))
    raise ChannelError(f"column {name} is {a.simpleString()} in one file and {b.simpleString()} in another")


def _bytes_of(kind: DataType) -> int:
    return {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.simpleString()]


def _as_decimal(kind: DataType) -> DecimalType:
    return kind if isinstance(kind, DecimalType) else DecimalType(_DIGITS[_bytes_of(kind)], 0)


def folded(schemas: Iterable[StructType], above: str = "") -> StructType:
    """One schema of all columns, in the order in which they first come; columns that a schema lacks are null there."""
    kinds: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema:
            kinds[f.name] = wider(kinds[f.name], f.dataType, f"{above}.{f.name}".lstrip(".")) if f.name in kinds else f.dataType
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def of_json(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def reads_as(own: StructType, wanted: StructType) -> bool:
    """Whether Spark's reader gives files of the schema ``own`` as ``wanted`` by itself: the same types, or integers of 4 bytes at most and floats as wider numbers."""
    kinds = {f.name: f.dataType for f in wanted}
    for f in own:
        to = kinds.get(f.name)
        small = isinstance(f.dataType, IntegralType) and _bytes_of(f.dataType) <= 4
        if to is not None and to != f.dataType and not (small and (isinstance(to, DoubleType) or isinstance(to, IntegralType))) and not (isinstance(f.dataType, FloatType) and isinstance(to, DoubleType)):
            return False
    return True
