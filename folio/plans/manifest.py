"""The manifest of a dataset: which pages it has, and whether it is complete."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.keys import join_key
from folio.sources.catalog import PARQUET

UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def now() -> str:
    return datetime.now(UTC).isoformat()


def timings(seconds: float) -> dict[str, float]:
    return {unit: seconds / n for unit, n in UNITS.items()}


def dataset_folder(kind: str, name: str, is_copied_header: bool = False) -> str:
    """The folder of a dataset below the root of all; a copied header is in its dataset's."""
    return join_key("dataset", kind, name, "header" if is_copied_header else None)


@dataclass
class Manifest:
    """What is published when a page is closed, and what readers go by: files it does not name do not count."""

    dataset: str
    dsType: str
    isHeader: bool = False
    headerName: str | None = None
    sourceId: str | None = None
    key: str = ""
    id: str = field(default_factory=lambda: str(uuid4()))
    type: str = "dataset"
    createdAt: str = field(default_factory=now)
    isComplete: bool = False
    pages: list[dict] = field(default_factory=list)
    timings: dict | None = None
    completedAt: str | None = None

    def __post_init__(self) -> None:
        self.key = self.key or join_key(dataset_folder(self.dsType, self.dataset), "manifest")

    def add_page(self, folder: str, part: int, seconds: float, n_keys: int, n_rows: int) -> dict:
        """Appends a page whose files are in ``folder``, written as page ``part`` there."""
        page = {
            "number": len(self.pages),
            "keyset": {"key": join_key(folder, "keyset", f"page={part}"), "contentType": PARQUET},
            "dataframe": {"key": join_key(folder, "dataframe", f"page={part}"), "contentType": PARQUET},
            "keyCount": n_keys,
            "rowCount": n_rows,
            "createdAt": now(),
            "timings": timings(seconds),
        }
        self.pages.append(page)
        return page

    def finish(self) -> None:
        self.isComplete, self.completedAt = True, now()
        self.timings = timings(sum(p["timings"]["seconds"] for p in self.pages))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Manifest:
        return Manifest(**json.loads(text))


def pages_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(page, n_keys, n_rows, seconds) of a manifest's pages, for SQL."""
    rows = [(p["number"], p["keyCount"], p["rowCount"], float(p["timings"]["seconds"])) for p in manifest.pages]
    return spark.createDataFrame(rows, "page long, n_keys long, n_rows long, seconds double")


def total_timings(pages: DataFrame) -> DataFrame:
    """Seconds, minutes, hours and days over all pages."""
    seconds = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return pages.agg(*[(seconds / n).alias(unit) for unit, n in UNITS.items()])
