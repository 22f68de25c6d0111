"""Reading datasets: whole, by page, or their keys only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.columns import drawn_place
from folio.functions.keys import draw, join_key
from folio.operators.sets import union_by_name
from folio.plans.manifest import Manifest, dataset_folder
from folio.sources.files import Files


class DatasetReader:
    """A dataset as its manifest has it; files that the manifest does not name are not seen."""

    def __init__(self, spark: SparkSession, root: str, kind: str, name: str, copied_header: bool = False) -> None:
        self._spark, self.root, self.kind, self.name, self._copied = spark, root.rstrip("/"), kind, name, copied_header
        self._files = Files(spark)

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/{join_key(dataset_folder(self.kind, self.name, self._copied), 'manifest')}"

    @property
    def exists(self) -> bool:
        return self._files.exists(self.manifest_path)

    @property
    def manifest(self) -> Manifest:
        return Manifest.from_json(self._files.read(self.manifest_path))

    @property
    def is_complete(self) -> bool:
        return self.exists and self.manifest.isComplete

    @property
    def header(self) -> DatasetReader:
        """The header that the dataset was built from, as it was then."""
        return DatasetReader(self._spark, self.root, self.kind, self.name, True)

    def _read(self, pages: list[dict], part: str) -> DataFrame:
        paths = [f"{self.root}/{p[part]['key']}" for p in pages]
        schemas: dict[str, list[str]] = {}
        # pages of one folder were written by one query and so have one schema
        for path in paths:
            schemas.setdefault(path.rsplit("/page=", 1)[0], []).append(path)
        return union_by_name([self._spark.read.parquet(*group) for group in schemas.values()])

    def dataframe(self) -> DataFrame:
        """All rows of all pages, with ``page`` dropped; columns that a page lacks are null."""
        pages = self.manifest.pages
        return self._read(pages, "dataframe") if pages else self._spark.createDataFrame([], "key string")

    def paged(self, name: str = "page") -> DataFrame:
        """All rows with the number of their page in column ``name``: filters on it prune the pages' folders, others reach the scan."""
        runs: dict[str, list[dict]] = {}
        for p in self.manifest.pages:
            runs.setdefault(p["dataframe"]["key"].rsplit("/page=", 1)[0], []).append(p)
        frames = []
        for folder, pages in runs.items():
            base = f"{self.root}/{folder}"
            part = lambda p: int(p["dataframe"]["key"].rsplit("=", 1)[1])
            kind = self._spark.read.parquet(f"{self.root}/{pages[0]['dataframe']['key']}").schema
            if name in kind.names or "page" in kind.names:
                raise ValueError(f"the dataset has a column of the name {name} or page")
            rows = self._spark.read.schema(kind.add("page", "long")).option("basePath", base).parquet(*[f"{base}/page={part(p)}" for p in pages])
            # pages of a run follow each other, in its numbers and in the dataset's
            frames.append(rows.select(*[f"`{c}`" for c in rows.columns if c != "page"], (F.col("page") + (pages[0]["number"] - part(pages[0]))).alias(name)))
        return union_by_name(frames) if frames else self._spark.createDataFrame([], f"key string, {name} long")

    def keys(self) -> DataFrame:
        """(key, key_ord) of all pages; ``key_ord`` goes up from page to page."""
        pages = self.manifest.pages
        return self._read(pages, "keyset") if pages else self._spark.createDataFrame([], "key string, key_ord long")

    def keyset(self) -> list[str]:
        """The keys in order; for datasets whose keys fit on the driver."""
        return [r["key"] for r in self.keys().orderBy("key_ord").collect()]

    def page(self, number: int) -> tuple[DataFrame, DataFrame]:
        """(rows, keys) of one page; only its files are read."""
        one = [p for p in self.manifest.pages if p["number"] == number]
        if not one:
            raise IndexError(f"{self.name} has no page {number}")
        return self._read(one, "dataframe"), self._read(one, "keyset").select("key", "key_ord")

    def pages(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        for p in self.manifest.pages:
            yield self.page(p["number"])

    def key_at(self, index: int) -> str:
        """The key at a position in key order: a look-up by the position that is kept with the keys."""
        row = self.keys().where(F.col("key_ord") == index).select("key").first()
        if row is None:
            raise IndexError(index)
        return row["key"]

    def random_key(self, seed: int | None = None) -> str:
        """A key of the dataset, each as likely as the others."""
        return self.random_keys([seed])[0]

    def random_keys(self, seeds: Iterable[int | None]) -> list[str]:
        """A key for each seed, the one that ``random_key`` draws by it; all are looked up at once."""
        n = self._drawable()
        drawn = [draw(seed, n) for seed in seeds]
        held = {r["key_ord"]: r["key"] for r in self.keys().where(F.col("key_ord").isin(sorted(set(drawn)))).select("key_ord", "key").collect()}
        return [held[i] for i in drawn]

    def drawn_keys(self, seeds: DataFrame) -> DataFrame:
        """The rows of ``seeds`` with the ``key`` that ``random_key`` draws by their ``seed``, a whole number: for any number of seeds. A null seed draws none."""
        at = seeds.withColumn("_at", drawn_place(F.col("seed"), self._drawable()))
        return at.join(self.keys().select(F.col("key_ord").alias("_at"), "key"), "_at", "left").drop("_at")

    def _drawable(self) -> int:
        n = sum(p["keyCount"] for p in self.manifest.pages)
        if not n:
            raise IndexError(f"{self.name} has no keys")
        return n
