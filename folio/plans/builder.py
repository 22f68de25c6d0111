"""Building datasets: stage, count, page, commit; and taking up again what was left.

A run works off the keys that are to be done in chunks. The rows of a chunk are
staged once, its keys are dealt to pages, and the closed pages are written and
published in the manifest. The keys of the page that is still open go to the
next chunk, so that a run that was interrupted and taken up again gives the
pages that one run would have given.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from folio.errors import ChannelError, DatasetExists, EmptyDataset
from folio.functions.keys import join_key
from folio.operators.grouped import Streamed, Whole, by_key, streamed_by_key
from folio.operators.paging import PageLimits, assign_pages, ranked_keys, row_bytes, row_limit
from folio.operators.sets import remaining_keys, rows_per_key
from folio.plans.manifest import Manifest, dataset_folder
from folio.plans.reader import DatasetReader
from folio.sources.files import Files

Transform = Callable[[dict[str, DataFrame]], DataFrame]
Channels = Callable[[DataFrame], dict[str, DataFrame]]
BEHAVIORS = ("continue", "overwrite", "pass", "fail")
#: Rows, and keys, that one file of a page has about.
ROWS_PER_FILE = 1_000_000
KEYS_PER_FILE = 5_000_000
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Progress:
    """How far a build is, told after each chunk that closed pages: of this run's keys, and of all pages of the dataset."""

    dataset: str
    pages: int
    keys_done: int
    keys: int
    rows_of_chunk: int
    rows: int
    seconds: float

    @property
    def percent(self) -> float:
        return 100 * self.keys_done / self.keys

    @property
    def seconds_left(self) -> float:
        return self.seconds / self.keys_done * (self.keys - self.keys_done)


class DatasetBuilder:
    """Builds dataset ``name`` from the keys of ``header`` and the channels that ``channels`` gives for them.

    ``if_partial`` and ``if_complete`` say what to do with a dataset that is
    there: 'continue' it (a complete one is passed), 'overwrite' it, 'pass'
    over it or 'fail'. Continuing goes by the header as it was when the
    dataset was begun, which is kept beside it.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        header: DatasetReader | None,
        channels: Channels,
        kind: str,
        limits: PageLimits | None = None,
        if_complete: str = "pass",
        if_partial: str = "continue",
        chunk_keys: int | None = None,
        compression: str = "gzip",
        is_header: bool = False,
        source_id: str | None = None,
        on_progress: Callable[[Progress], None] | None = None,
    ) -> None:
        for value in (if_complete, if_partial):
            if value not in BEHAVIORS:
                raise ValueError(f"{value} is none of {', '.join(BEHAVIORS)}")
        self._spark, self.root, self.name, self.kind = spark, root.rstrip("/"), name, kind
        self._header, self._channels, self._limits = header, channels, limits or PageLimits()
        self._if = {True: if_complete, False: if_partial}
        self._chunk, self._compression, self._is_header, self._source_id = chunk_keys, compression, is_header, source_id
        self._files, self._on_progress = Files(spark), on_progress
        self.reader = DatasetReader(spark, root, kind, name)

    def build(self, transform: Transform, keys: DataFrame | None = None) -> DatasetReader:
        """Runs ``transform`` over the channels of all keys that are to be done, chunk by chunk.

        It gets DataFrames with a ``key`` column and returns one, which may
        have other columns of any names. A key for which it returns no rows is
        recorded as done.
        """
        return self._build(lambda channels, _: transform(channels), keys)

    def _build(self, transform: Callable[[dict[str, DataFrame], DataFrame], DataFrame], keys: DataFrame | None = None) -> DatasetReader:
        todo, manifest = self._decide(keys)
        if todo is None:
            return self.reader
        self._publish(manifest)
        folder = dataset_folder(self.kind, self.name)
        # ranked once; a chunk is a range of positions, which the scan of the file can skip to
        ordered_path = f"{self.root}/{join_key(folder, '_staging', f'keys-{uuid4().hex}')}"
        ranked_keys(todo.where("key is not null")).write.parquet(ordered_path)
        ordered = self._spark.read.parquet(ordered_path)
        started, done, total = time.time(), 0, ordered.count()
        while done < total:
            more = bool(self._chunk) and done + self._chunk < total
            mine = ordered.where(F.col("key_ord") >= done)
            mine = (mine.where(F.col("key_ord") < done + self._chunk) if more else mine).select("key", (F.col("key_ord") - done).alias("key_ord"))
            begun, run = time.time(), f"run-{uuid4().hex}"
            staged_path = f"{self.root}/{join_key(folder, '_staging', run)}"
            made = transform(self._channels(mine.select("key")), mine.select("key"))
            made.write.parquet(staged_path)
            staged = self._spark.read.schema(made.schema).parquet(staged_path)
            counts = mine.join(rows_per_key(mine, staged), "key")
            paged = assign_pages(counts, self._limits, row_bytes(staged.schema), ord_col="key_ord")
            paged_path = f"{staged_path}-pages"
            paged.write.parquet(paged_path)
            paged = self._spark.read.parquet(paged_path)
            summary = paged.groupBy("page").agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).orderBy("page").collect()
            if more:
                summary = self._closed(summary, row_bytes(staged.schema))
            if not summary and more:  # the open page is longer than a chunk
                self._chunk *= 2
            elif summary:
                self._write(staged, paged, summary, join_key(folder, run), sum(p["keyCount"] for p in manifest.pages))
                for r in summary:
                    manifest.add_page(join_key(folder, run), r["page"], (time.time() - begun) / len(summary), r["n"], r["rows"])
                done += sum(r["n"] for r in summary)
                self._publish(manifest)
                self._tell(Progress(self.name, len(manifest.pages), done, total, sum(r["rows"] for r in summary), sum(p["rowCount"] for p in manifest.pages), time.time() - started))
            for path in (staged_path, paged_path):
                self._files.delete(path)
        self._files.delete(ordered_path)
        manifest.finish()
        self._publish(manifest)
        return self.reader

    def build_by_key(self, function: Whole, schema: StructType | str, channels: Sequence[str] | None = None, order: Mapping[str, Sequence[str]] | None = None) -> DatasetReader:
        """Builds from a function of all channels of a key, as pandas frames by channel; the result gets its ``key``.

        ``channels`` names those that it takes, by default all. The function is
        called for every key that is to be done, also for one without rows in
        any channel; a channel without rows is an empty frame. ``order`` names
        columns by which a channel's rows are sorted.
        """
        return self._build(lambda got, keys: by_key(function, self._taken(got, channels), schema, keys, order=order))

    def build_streamed(self, function: Streamed, schema: StructType | str, channels: Sequence[str] | None = None, order: Mapping[str, Sequence[str]] | None = None) -> DatasetReader:
        """As ``build_by_key``, from a function of a key and an iterator of (channel, pandas rows): no key is held whole."""
        return self._build(lambda got, keys: streamed_by_key(function, self._taken(got, channels), schema, keys, order=order))

    @staticmethod
    def _taken(got: dict[str, DataFrame], channels: Sequence[str] | None) -> dict[str, DataFrame]:
        if unknown := set(channels or ()) - set(got):
            raise ChannelError(f"channels {sorted(unknown)} are not read")
        return got if channels is None else {name: got[name] for name in channels}

    def _decide(self, keys: DataFrame | None) -> tuple[DataFrame | None, Manifest | None]:
        there = self.reader.exists
        complete = there and self.reader.is_complete
        behavior = self._if[complete] if there else "overwrite"
        if behavior == "fail":
            raise DatasetExists(f"dataset {self.name} exists")
        if behavior == "pass" or complete and behavior == "continue":
            return None, None
        if behavior == "continue":
            held = self.reader.header if self.reader.header.exists else self._header
            given = keys if held is None else held.keys()
            return remaining_keys(given, self.reader.keys()), self.reader.manifest
        given = keys if keys is not None else self._header.keys()
        given = given.select("key").distinct()
        if given.isEmpty():
            raise EmptyDataset(f"dataset {self.name} would have no keys")
        source = self._header.manifest if self._header is not None else None
        manifest = Manifest(self.name, self.kind, self._is_header, self._header.name if self._header else None, source.id if source else self._source_id)
        if self._header is not None:
            self._copy_header(source)
        return given, manifest

    def _copy_header(self, source: Manifest) -> None:
        folder, run = dataset_folder(self.kind, self.name, True), f"run-{uuid4().hex}"
        rows, keys = self._header.dataframe(), self._header.keys()
        rows.write.option("compression", self._compression).parquet(f"{self.root}/{join_key(folder, run, 'dataframe', 'page=0')}")
        keys.write.option("compression", self._compression).parquet(f"{self.root}/{join_key(folder, run, 'keyset', 'page=0')}")
        copy = Manifest(self.name, self.kind, True, source.headerName, source.id, join_key(folder, "manifest"))
        copy.add_page(join_key(folder, run), 0, 0.0, sum(p["keyCount"] for p in source.pages), sum(p["rowCount"] for p in source.pages))
        copy.finish()
        self._files.publish(f"{self.root}/{copy.key}", copy.to_json())

    def _closed(self, summary: list, bytes_per_row: int) -> list:
        """All pages but the last, unless the last is closed too."""
        last = summary[-1]
        full = last["n"] % self._limits.check_every == 0 and last["rows"] > row_limit(self._limits, bytes_per_row)
        return summary if full else summary[:-1]

    def _write(self, staged: DataFrame, paged: DataFrame, summary: list, folder: str, offset: int) -> None:
        """Writes closed pages, each in as many files as its rows and keys take."""
        parts = [(r["page"], -(-r["rows"] // ROWS_PER_FILE) or 1, -(-r["n"] // KEYS_PER_FILE)) for r in summary]
        pages = F.broadcast(self._spark.createDataFrame(parts, "page long, _files long, _key_files long"))  # a row for each page
        place = paged.join(pages, "page").select("key", "page", (F.col("key_ord") + offset).alias("key_ord"), "_files", "_key_files")
        # the rows' columns go by number, so that none is taken for the page's; its folder tells it
        plain = staged.toDF(*[f"c{k}" for k in range(len(staged.columns))])
        key = f"c{staged.columns.index('key')}"
        rows = plain.join(place.select(F.col("key").alias(key), "page", "_files"), key)
        hashed = [c for c, f in zip(plain.columns, staged.schema, strict=True) if not isinstance(f.dataType, (MapType, VariantType))]
        part = F.pmod(F.xxhash64(*hashed), F.col("_files"))  # of the whole row: a key may have many
        folder_of = next(n for n in ("page", *(f"page_{k}" for k in range(len(staged.columns) + 1))) if n not in staged.columns)
        rows = rows.repartition(sum(p[1] for p in parts), "page", part).select(*plain.columns, "page").toDF(*staged.columns, folder_of)
        rows.write.partitionBy(folder_of).option("compression", self._compression).parquet(f"{self.root}/{join_key(folder, 'dataframe')}")
        if folder_of != "page":  # readers know pages by that name
            for path in self._files.list(f"{self.root}/{join_key(folder, 'dataframe')}"):
                if f"/{folder_of}=" in path:
                    self._files.move(path, path.replace(f"/{folder_of}=", "/page="))
        keys = place.repartition(sum(p[2] for p in parts), "page", F.pmod(F.xxhash64("key"), F.col("_key_files"))).select("key", "page", "key_ord")
        keys.write.partitionBy("page").option("compression", self._compression).parquet(f"{self.root}/{join_key(folder, 'keyset')}")
        for page in (r["page"] for r in summary if not r["rows"]):  # a page of keys without rows
            staged.limit(0).coalesce(1).write.parquet(f"{self.root}/{join_key(folder, 'dataframe', f'page={page}')}")

    def _tell(self, progress: Progress) -> None:
        log.info("dataset %s: %d pages, %d of %d keys (%.1f %%), %d rows, %.0f s left", progress.dataset, progress.pages, progress.keys_done, progress.keys, progress.percent, progress.rows, progress.seconds_left)
        if self._on_progress is not None:
            self._on_progress(progress)

    def _publish(self, manifest: Manifest) -> None:
        self._files.publish(f"{self.root}/{manifest.key}", manifest.to_json())
