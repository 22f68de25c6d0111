"""Revisions of published datasets: choosing them by date and exporting their assets.

The catalog of revisions is a DataFrame (dataset_id, revision_id, comment,
created_at) and that of assets another (revision_id, name, path). ``listed``
fills them from a folder; a marketplace's listing is the caller's.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import time
import warnings
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.errors import FolioError
from folio.functions.columns import date_between
from folio.sources.scratch import discard, stored

MANY_ASSETS = 500
#: Assets that one task copies at most in a go.
ASSETS_PER_TASK = 8
#: Assets of more bytes are copied by ranges of so many, where the target is on a file system that takes them, by so many tasks at most.
RANGE_BYTES = 256 << 20
MOST_TASKS = 10_000
#: The states of an export job that end it without success, and what is said of them.
FAILED_STATES = {"ERROR": "failed", "CANCELLED": "was cancelled", "TIMED_OUT": "timed out"}
DONE_STATE = "COMPLETED"


def finished_job(look: Callable[[], Mapping], poll_seconds: float = 2.0) -> Mapping:
    """Looks at an export job until it is done, and returns it; a job that ends otherwise is an error."""
    while True:
        job = look()
        state = job.get("State")
        if state == DONE_STATE:
            return job
        if state in FAILED_STATES:
            errors = job.get("Errors") or [{}]
            why = f": {errors[0]['Message']}" if errors[0].get("Message") else ""
            raise FolioError(f"job {job.get('Id')} {FAILED_STATES[state]}{why}")
        time.sleep(poll_seconds)


def copy_file(source: str, target: str) -> bool:
    """Copies a file between any file systems that Arrow knows, unless the target is there; whether it did.

    The copy goes beside the target and is moved into place, so that a target
    is always whole.
    """
    from uuid import uuid4

    from pyarrow import fs

    def at(path: str) -> tuple:
        path = re.sub(r"^file:/+", "/", path)  # as Spark writes local paths
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)

    (held, a), (to, b) = at(source), at(target)
    if to.get_file_info(b).type != fs.FileType.NotFound:
        return False
    to.create_dir(b.rsplit("/", 1)[0], recursive=True)
    beside = f"{b.rsplit('/', 1)[0]}/.{b.rsplit('/', 1)[1]}.{uuid4().hex}.new"
    with held.open_input_stream(a) as read, to.open_output_stream(beside) as write:
        while block := read.read(1 << 22):
            write.write(block)
    to.move(beside, b)
    return True


def _local(path: str) -> str | None:
    """A path of a local or mounted file system, as one can write into the middle of; else None."""
    path = re.sub(r"^file:/+", "/", path)
    return None if "://" in path else path


def _beside(source: str, target: str, size: int) -> str:
    """Where a large target is put together: the same in every run, as long as the source has its size."""
    folder, name = target.rsplit("/", 1)
    return f"{folder}/.{name}.{hashlib.sha256(f'{source}:{size}'.encode()).hexdigest()[:16]}"


def copy_range(source: str, target: str, size: int, at: int, length: int) -> bool:
    """Copies a range of a large file to its place in the hidden file beside the target; whether it did.

    A range that the ledger has, an empty file for each, is skipped: what
    another run has copied is not copied again.
    """
    from pyarrow import fs

    held = _beside(source, target, size)
    done = f"{held}.done/{at}-{length}"
    if os.path.exists(done) or os.path.exists(target):
        return False
    os.makedirs(f"{held}.done", exist_ok=True)
    path = _local(source)
    files, path = (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(source.replace("s3a://", "s3://", 1))
    out = os.open(f"{held}.new", os.O_CREAT | os.O_WRONLY)
    try:
        with files.open_input_file(path) as read:
            read.seek(at)
            left, to = length, at
            while left:
                block = read.read(min(left, 1 << 22))
                if not block:
                    raise OSError(f"{source} ends before {at + length}")
                to += os.pwrite(out, block, to)
                left -= len(block)
        os.fsync(out)
    finally:
        os.close(out)
    with open(done, "w"):
        pass
    return True


def join_ranges(source: str, target: str, size: int, range_bytes: int) -> bool:
    """Moves a file of which every range is there into place, in one step, and removes its ledger; whether it did."""
    held = _beside(source, target, size)
    if os.path.exists(target):
        shutil.rmtree(f"{held}.done", ignore_errors=True)
        return False
    lacks = [at for at in range(0, size, range_bytes) if not os.path.exists(f"{held}.done/{at}-{min(range_bytes, size - at)}")]
    if lacks or os.path.getsize(f"{held}.new") != size:
        raise OSError(f"{target} lacks {len(lacks)} ranges")
    os.replace(f"{held}.new", target)
    shutil.rmtree(f"{held}.done", ignore_errors=True)
    return True


def listed(spark: SparkSession, root: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(revisions, assets) of a dataset that is kept in a folder: each folder below is a revision, named by its comment.

    A revision was created when its first file was; assets are named by their
    path from the revision's folder on. Only the listing is read.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "modificationTime")
    tail = F.substring_index("path", f"{base.split('://', 1)[-1].lstrip('/')}/", -1)
    known = files.select("path", F.col("modificationTime").alias("at"), F.substring_index(tail, "/", 1).alias("revision_id"), tail.alias("tail")).where(F.contains("tail", F.lit("/")))
    revisions = known.groupBy("revision_id").agg(F.min("at").alias("created_at")).select(F.lit(dataset_id).alias("dataset_id"), "revision_id", F.col("revision_id").alias("comment"), "created_at")
    name = F.substr("tail", F.length("revision_id") + 2)
    return revisions, known.select("revision_id", name.alias("name"), "path")


def revisions_between(revisions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The revisions whose comment's day is in [start, end)."""
    return revisions.where(date_between(F.col("comment"), start, end))


def latest_revision(revisions: DataFrame) -> str | None:
    """The id of the revision that was created last; of those of one time the greatest id."""
    row = revisions.orderBy(F.desc_nulls_last("created_at"), F.desc("revision_id")).select("revision_id").first()
    return row["revision_id"] if row else None


class RevisionExporter:
    """Copies assets to ``<root>/[<prefix>/]<asset name>``; what is there already is left alone.

    Assets are copied by tasks, ``copy`` by ``copy``: a function of source and
    target that says whether it copied. Another one may first run an export
    job and wait for it with ``finished_job``.
    """

    def __init__(self, spark: SparkSession, revisions: DataFrame, assets: DataFrame, root: str, prefix: str | None = None, copy: Callable[[str, str], bool] = copy_file, range_bytes: int = RANGE_BYTES) -> None:
        self.range_bytes = range_bytes
        self._spark, self.revisions, self.assets, self.root, self.prefix, self._copy = spark, revisions, assets, root.rstrip("/"), prefix, copy

    def target(self, name: str) -> str:
        prefix = (self.prefix or "").strip("/")
        return f"{self.root}/{prefix}/{name}" if prefix else f"{self.root}/{name}"

    @property
    def _query_name(self) -> str:
        """The same in every process, so that another one finds this exporter's queries."""
        return f"auto-export-{hashlib.sha256(self.target('').encode()).hexdigest()[:16]}"

    def export(self, revision_id: str | None = None) -> int:
        """Exports one revision, the latest if none is named; returns the number of files copied."""
        wanted = revision_id or latest_revision(self.revisions)
        if wanted is None:
            raise FolioError("no revisions in the dataset")
        assets = self.assets.where(F.col("revision_id") == wanted)
        n = assets.count()
        if n > MANY_ASSETS:
            warnings.warn(f"revision {wanted} has {n} assets", stacklevel=2)
        copy, head = self._copy, self.target("")
        large = self._large(assets, head) if copy is copy_file and _local(head) else None
        if large is not None:
            assets = assets.join(large.select("name").distinct(), "name", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"copied": [bool(copy(path, f"{head}{name}")) for name, path in zip(batch["name"], batch["path"], strict=True)]})

        # by name, so that two assets of one target are copied by one task
        tasks = max(1, -(-n // ASSETS_PER_TASK))
        done = assets.select("name", "path").repartition(tasks, "name").mapInPandas(run, "copied boolean")
        copied = done.agg(F.count_if("copied").alias("n")).first()["n"]
        return copied + (self._in_ranges(large, head) if large is not None else 0)

    def _large(self, assets: DataFrame, head: str) -> DataFrame | None:
        """(name, path, size) of the assets that several tasks copy, each target once; None if there are none."""
        least = self.range_bytes

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            for batch in batches:
                sizes = []
                for path in batch["path"]:
                    own = _local(path)
                    files, at = (fs.LocalFileSystem(), own) if own else fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                    sizes.append(files.get_file_info(at).size or 0)
                yield batch.assign(size=sizes)

        one = assets.groupBy("name").agg(F.min("path").alias("path"))
        found = stored(one.mapInPandas(look, "name string, path string, size long").where(F.col("size") > least), "large")
        if found.isEmpty():
            discard(found)
            return None
        return found

    def _in_ranges(self, large: DataFrame, head: str) -> int:
        """Copies large assets by ranges, each a row of its own, and then moves them into place; returns how many were not there."""
        step, target = self.range_bytes, _local(head)

        def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = zip(batch["path"], batch["name"], batch["size"], batch["at"], strict=True)
                yield pd.DataFrame({"copied": [copy_range(path, f"{target}{name}", size, at, min(step, size - at)) for path, name, size, at in rows]})

        def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"moved": [join_ranges(path, f"{target}{name}", size, step) for path, name, size in zip(batch["path"], batch["name"], batch["size"], strict=True)]})

        n = large.agg(F.sum(F.ceil(F.col("size") / step))).first()[0]
        ranges = large.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("at"))
        ranges.repartition(max(1, min(int(n), MOST_TASKS)), "name", "at").mapInPandas(ranged, "copied boolean").agg(F.count("*")).collect()
        moved = large.repartition("name").mapInPandas(joined, "moved boolean").agg(F.count_if("moved").alias("n")).first()["n"]
        discard(large)
        return moved

    def export_between(self, start: str | None = None, end: str | None = None) -> int:
        """Exports the revisions of a range of days, one after the other."""
        chosen = revisions_between(self.revisions, start, end).orderBy("created_at", "revision_id").select("revision_id")
        return sum(self.export(r["revision_id"]) for r in chosen.toLocalIterator())

    def start_auto_export(self, published: DataFrame, checkpoint: str, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
        """Exports each revision of a stream of (revision_id) as it comes, until the query is stopped.

        A batch that fails is run again, and copies that were made are skipped.
        """

        def run(batch: DataFrame, number: int) -> None:
            for r in batch.select("revision_id").distinct().toLocalIterator():
                self.export(r["revision_id"])
            if on_batch:
                on_batch(number)

        return published.writeStream.queryName(self._query_name).option("checkpointLocation", checkpoint).foreachBatch(run).start()

    def stop_auto_export(self) -> int:
        """Stops this exporter's running queries; returns how many there were."""
        running = [q for q in self._spark.streams.active if q.name == self._query_name]
        for q in running:
            q.stop()
        return len(running)
