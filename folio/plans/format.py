"""Datasets as a data source: ``spark.read.format("folio_dataset")`` and ``df.write.format("folio_dataset")``.

Reading plans a partition for each file of the pages that the option ``pages``
asks for ("3", "2-5,7"), and names the files of others to no task. Filters are
not pushed to the source: of a Python source that took one, Spark 4.1 leaves
out the same rows in later scans of the frame that have no filter. To prune
pages by filters there is ``DatasetReader.paged``. Writing is a commit in two steps: tasks put files aside, and
only when all have succeeded are the files of their last attempts moved to
their pages and the manifest published over the old one. A task or a job that
fails leaves nothing that a reader sees, and its files are removed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructType

from folio.functions.keys import join_key
from folio.operators.paging import PageLimits, assign_pages, row_bytes
from folio.operators.sets import rows_per_key
from folio.plans.manifest import Manifest, dataset_folder
from folio.sources.scratch import stored

NAME = "folio_dataset"
PAGE = "page"


class _Place:
    """A dataset's files on any file system that Arrow knows by address."""

    def __init__(self, options: dict) -> None:
        missing = [x for x in ("root", "kind", "name") if x not in options]
        if missing:
            raise ValueError(f"missing options {', '.join(missing)}")
        root, self.kind, self.name = options["root"].rstrip("/"), options["kind"], options["name"]
        self.files, self.root = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        self.folder = dataset_folder(self.kind, self.name)

    def at(self, key: str) -> str:
        return f"{self.root}/{key}"

    def manifest(self) -> Manifest | None:
        path = self.at(join_key(self.folder, "manifest"))
        if self.files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(path) as f:
            return Manifest.from_json(f.read().decode())

    def parts(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))

    def publish(self, manifest: Manifest) -> None:
        path = self.at(manifest.key)
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid4().hex}.new"
        with self.files.open_output_stream(beside) as f:
            f.write(manifest.to_json().encode())
        self.files.move(beside, path)

    def remove(self, folder: str) -> None:
        if self.files.get_file_info(self.at(folder)).type == fs.FileType.Directory:
            self.files.delete_dir(self.at(folder))


@dataclass
class _File(InputPartition):
    page: int
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self._options, self._schema = options, schema
        self._spans = [[int(x) for x in part.split("-")] for part in options["pages"].split(",")] if "pages" in options else None

    def partitions(self) -> list[InputPartition]:
        place = _Place(self._options)
        manifest = place.manifest()
        wanted = [p for p in (manifest.pages if manifest else []) if self._spans is None or any(s[0] <= p["number"] <= s[-1] for s in self._spans)]
        return [_File(p["number"], path) for p in wanted for path in place.parts(p["dataframe"]["key"])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        place, kinds = _Place(self._options), to_arrow_schema(self._schema)
        with place.files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                columns = [
                    batch.column(k.name).cast(k.type) if k.name in batch.schema.names else pa.array(np.full(batch.num_rows, partition.page, np.int64)) if k.name == PAGE else pa.nulls(batch.num_rows, k.type)
                    for k in kinds
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[int, str, str, int]]  # page, part of the dataset, path, rows


class _Writer(DataSourceArrowWriter):
    """Takes rows of (key, page, key_ord, row): ``row`` has the dataset's columns but the key, and is null for a key without rows.

    A key's rows must be in one task; pages should come in order.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        if [f.name for f in schema] != ["key", PAGE, "key_ord", "row"]:
            raise ValueError("rows to be written have the columns key, page, key_ord and row")
        self._options, self._overwrite, self._begun = options, overwrite, time.time()
        self._run = f"run-{uuid4().hex}"
        self._place_of_run = join_key(_Place(options).folder, "_staging", self._run)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        place, mine = _Place(self._options), f"{self._place_of_run}/{uuid4().hex}"
        compression = self._options.get("compression", "gzip")
        place.files.create_dir(place.at(mine), recursive=True)
        written: list[tuple[int, str, str, int]] = []
        open_, page, last = {}, None, None

        def shut() -> None:
            for part, (path, writer, n) in open_.items():
                writer.close()
                written.append((page, part, path, n))
            open_.clear()

        def put(part: str, table: pa.Table) -> None:
            if part not in open_:
                path = place.at(f"{mine}/{part}-{len(written)}-{page}.parquet")
                open_[part] = [path, pq.ParquetWriter(path, table.schema, filesystem=place.files, compression=compression), 0]
            open_[part][1].write_table(table)
            open_[part][2] += table.num_rows

        try:
            for batch in batches:
                pages, keys = np.asarray(batch[PAGE]), batch["key"]
                codes = np.asarray(keys.dictionary_encode().indices)
                starts = np.flatnonzero(np.concatenate([[True], pages[1:] != pages[:-1]])) if len(pages) else []
                for a, b in zip(starts, np.append(starts[1:], len(pages)), strict=True):
                    if pages[a] != page:
                        shut()
                        page, last = int(pages[a]), None
                    own = batch.slice(a, b - a)
                    first = np.concatenate([[True], codes[a + 1 : b] != codes[a : b - 1]])
                    first[0] = keys[int(a)].as_py() != last
                    last = keys[int(b) - 1].as_py()
                    put("keyset", pa.table({"key": own["key"], "key_ord": own["key_ord"]}).filter(pa.array(first)))
                    has = pc.is_valid(own["row"])
                    row = own["row"].filter(has)
                    put("dataframe", pa.table([own["key"].filter(has), *row.flatten()], names=["key", *[f.name for f in row.type]]))
            shut()
        except BaseException:
            for _, writer, _ in open_.values():
                writer.close()
            place.remove(mine)
            raise
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        place = _Place(self._options)
        there = None if self._overwrite else place.manifest()
        manifest = there or Manifest(place.name, place.kind)
        found: dict[int, dict[str, list]] = {}
        for m in messages:
            for page, part, path, n in m.parts if m else ():
                found.setdefault(page, {"keyset": [], "dataframe": []})[part].append((path, n))
        folder = join_key(place.folder, self._run)
        for page in sorted(found):
            for part, parts in found[page].items():
                target = place.at(join_key(folder, part, f"page={page}"))
                place.files.create_dir(target, recursive=True)
                for k, (path, _) in enumerate(parts):
                    place.files.move(path, f"{target}/part-{k:05d}.parquet")
            n_keys, n_rows = (sum(n for _, n in found[page][part]) for part in ("keyset", "dataframe"))
            manifest.add_page(folder, page, (time.time() - self._begun) / len(found), n_keys, n_rows)
        manifest.finish()
        place.publish(manifest)  # from here on readers see the pages
        place.remove(self._place_of_run)

    def abort(self, messages: list[_Written | None]) -> None:
        place = _Place(self._options)
        place.remove(self._place_of_run)
        place.remove(join_key(place.folder, self._run))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""

    class PagedDataset(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> StructType:
            place = _Place(self.options)
            manifest = place.manifest()
            if manifest is None:
                raise FileNotFoundError(f"there is no dataset {place.name}")
            folders: dict[str, str] = {}
            for p in manifest.pages:  # pages of one run were written by one query and so have one schema
                folders.setdefault(p["dataframe"]["key"].rsplit("/", 1)[0], p["dataframe"]["key"])
            kinds = []
            for folder in folders.values():
                for path in place.parts(folder)[:1]:
                    with place.files.open_input_file(path) as f:
                        kinds.append(pq.read_schema(f).remove_metadata())
            if not kinds:
                kinds = [pa.schema([("key", pa.string())])]
            found = from_arrow_schema(pa.unify_schemas(kinds, promote_options="permissive"))
            return found if PAGE in found.names else found.add(PAGE, LongType())

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(dict(self.options), schema)

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            return _Writer(dict(self.options), schema, overwrite)

    spark.dataSource.register(PagedDataset)


def to_write(rows: DataFrame, keys: DataFrame, limits: PageLimits | None = None) -> DataFrame:
    """(key, page, key_ord, row): rows with a ``key`` column as the format takes them, paged by ``limits``; ``keys`` are all keys, those without rows too."""
    counts = stored(rows_per_key(keys.where("key is not null"), rows), "counts")
    place = assign_pages(counts, limits or PageLimits(), row_bytes(rows.schema)).select("key", PAGE, "key_ord")
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns if c != "key"]
    nested = rows.select(F.col("key"), (F.struct(*quoted) if quoted else F.struct(F.lit(True).alias("is"))).alias("row"))
    return place.join(nested, "key", "left").select("key", PAGE, "key_ord", "row").repartition(PAGE, "key").sortWithinPartitions(PAGE, "key_ord")


def write_dataset(rows: DataFrame, keys: DataFrame, root: str, kind: str, name: str, limits: PageLimits | None = None, mode: str = "overwrite", compression: str = "gzip") -> None:
    """Writes a dataset in one job and one commit; mode 'append' adds pages behind those that are there."""
    register(rows.sparkSession)
    to_write(rows, keys, limits).write.format(NAME).options(root=root, kind=kind, name=name, compression=compression).mode(mode).save()
