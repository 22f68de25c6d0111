"""A library of datasets over a collection of objects: the one place most users need."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import MissingOption
from folio.functions.keys import checked_instructions, warn_if_unusual_name
from folio.operators.paging import PageLimits
from folio.operators.sets import union_by_name
from folio.plans.builder import DatasetBuilder
from folio.plans.manifest import Manifest
from folio.plans.reader import DatasetReader
from folio.sources.catalog import Catalog, ObjectReader
from folio.sources.scratch import discard, stored

Selector = Column | str | Callable[[DataFrame], Column]
_MISSING = object()


def option(spark: SparkSession, name: str, value: str | None, default: object = _MISSING) -> str:
    """An option's value: the argument, else ``spark.folio.<name>``, else the environment's ``FOLIO_<NAME>``, else the default."""
    found = value or spark.conf.get(f"spark.folio.{name}", None) or os.environ.get(f"FOLIO_{name.upper()}")
    if found is None:
        if default is _MISSING:
            raise MissingOption(f"missing option {name}")
        return default
    return found


def selected(rows: DataFrame, selector: Selector | None) -> DataFrame:
    """The rows that a column, an SQL condition or a function from the frame to a column is true for."""
    if selector is None:
        return rows
    if callable(selector) and not isinstance(selector, Column):
        selector = selector(rows)
    return rows.where(selector)


class Library:
    """Datasets below ``dataset_root``, made of the objects below ``object_root``.

    With ``catalog_log``, a folder for the log of manifests, what is known of
    the objects is kept from one session to the next.
    """

    def __init__(self, spark: SparkSession, dataset_root: str | None = None, object_root: str | None = None, kind: str | None = None, default_header: str | None = None, catalog_log: str | None = None) -> None:
        self._spark = spark
        self.root = option(spark, "dataset_root", dataset_root)
        self.object_root = option(spark, "object_root", object_root)
        self.kind = option(spark, "kind", kind)
        self.default_header = option(spark, "default_header", default_header, "header")
        self._log = option(spark, "catalog_log", catalog_log, None)
        self.catalog = Catalog(spark, self.object_root, self.kind, log=self._log)

    def reader(self, name: str) -> DatasetReader:
        return DatasetReader(self._spark, self.root, self.kind, name)

    def header_reader(self) -> DatasetReader:
        return self.reader(self.default_header)

    def create_header(self, name: str | None = None) -> DatasetReader:
        """A dataset of the header rows of all objects, in one page."""
        found = self.catalog.refresh()
        return self._single_page(name or self.default_header, self.catalog.header(), None, str(found.version))

    def refresh_header(self, name: str | None = None) -> DatasetReader:
        """The header dataset brought up to date: the headers of objects that came or changed since are read, all others taken as they are.

        A header that is not there, or of which the catalog's log does not know
        the version, is made anew. One to which nothing changed stays as it is.
        """
        name = name or self.default_header
        held = self.reader(name)
        version = held.manifest.sourceId if held.is_complete else None
        found = self.catalog.refresh()
        if not (version or "").isdigit() or int(version) > found.version or self._log is None:
            return self._single_page(name, self.catalog.header(), None, str(found.version))
        changed = self.catalog.changed_since(int(version))
        if changed.isEmpty():
            return held
        changed = stored(changed, "changed")
        fresh = changed.where("not gone").select("key")
        kept = held.dataframe().join(changed, "key", "left_anti")
        rows = kept if fresh.isEmpty() else union_by_name([kept, self.catalog.header(fresh)])
        made = self._single_page(name, rows, None, str(found.version))
        discard(changed)
        return made

    def create_subheader(self, name: str, selector: Selector | None = None, source: str | None = None) -> DatasetReader:
        """A dataset of the header rows that are selected; all by default."""
        warn_if_unusual_name(name)
        held = self.reader(source or self.default_header)
        return self._single_page(name, selected(held.dataframe(), selector), held)

    def _single_page(self, name: str, rows: DataFrame, source: DatasetReader | None, source_id: str | None = None) -> DatasetReader:
        builder = DatasetBuilder(self._spark, self.root, name, None, lambda keys: {"header": rows}, self.kind, if_complete="overwrite", if_partial="overwrite", is_header=True, source_id=source_id)
        return builder.build(lambda channels: channels["header"], rows.select("key"))

    def dataframe(self, name: str) -> DataFrame:
        return self.reader(name).dataframe()

    def keyset(self, name: str) -> list[str]:
        return self.reader(name).keyset()

    def manifest(self, name: str) -> Manifest:
        return self.reader(name).manifest

    def pages(self, name: str) -> Iterator[tuple[DataFrame, DataFrame]]:
        return self.reader(name).pages()

    def object_at(self, index: int = 0, header: str | None = None) -> ObjectReader:
        """The object at a position in key order of a header dataset."""
        return self.object(self.reader(header or self.default_header).key_at(index))

    def random_object(self, header: str | None = None, seed: int | None = None) -> ObjectReader:
        return self.object(self.reader(header or self.default_header).random_key(seed))

    def random_objects(self, seeds: DataFrame, header: str | None = None) -> DataFrame:
        """The rows of ``seeds`` with ``key`` and, by its manifest, ``match_id`` of the object that ``random_object`` draws by their ``seed``."""
        found = self.catalog.manifests().select(F.col("manifest_key").alias("key"), F.col("id").alias("match_id"))
        return self.reader(header or self.default_header).drawn_keys(seeds).join(found, "key", "left").select(*[f"`{c}`" for c in seeds.columns], "key", "match_id")

    def object(self, key: str) -> ObjectReader:
        return ObjectReader(self._spark, self.object_root, key)

    def builder(self, name: str, header: str | None = None, instructions: Sequence | None = None, limits: PageLimits | None = None, **options) -> DatasetBuilder:
        """A builder of a dataset from the objects of a header dataset; ``build`` runs it."""
        warn_if_unusual_name(name)
        checked_instructions(instructions)
        return DatasetBuilder(self._spark, self.root, name, self.reader(header or self.default_header), lambda keys: self.catalog.read(instructions, keys), self.kind, limits, **options)


def header_of(rows: DataFrame, key: Column, object_id: Column) -> DataFrame:
    """Rows of any table as a header: with ``key`` and ``match_id``."""
    return rows.withColumns({"key": key, "match_id": object_id.cast("string")})
