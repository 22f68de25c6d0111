"""Datasets of a marketplace: its listings as frames, jobs that export revisions to a bucket, and exports on publication.

The marketplace's client is made by a function that the caller passes, once
for each task that calls it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import FolioError
from folio.sources.revisions import finished_job, latest_revision
from folio.sources.scratch import discard, stored

log = logging.getLogger(__name__)

#: Export jobs that are under way together; marketplaces allow few.
JOBS_AT_ONCE = 10
#: Revisions whose assets one task lists at most in a go.
REVISIONS_PER_TASK = 16


def key_pattern(prefix: str | None) -> str:
    """Where a job puts an asset in its bucket; a fixed format of the marketplace."""
    return f"{prefix or ''}${{Asset.Name}}"


class Marketplace:
    """A dataset of a marketplace.

    ``connect`` gives a client with ``get_paginator``, ``create_job``,
    ``start_job``, ``get_job``, ``create_event_action`` and
    ``delete_event_action``; it is sent to executors.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], Any], dataset_id: str, poll_seconds: float = 2.0) -> None:
        self._spark, self._connect, self.dataset_id, self._poll = spark, connect, dataset_id, poll_seconds

    def revisions(self) -> DataFrame:
        """(dataset_id, revision_id, comment, created_at) of all revisions, as they are now.

        Each page of the listing leads to the next, so that one task reads
        them; it holds a page at a time, and the result is a written table.
        """
        connect, dataset = self._connect, self.dataset_id

        def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _ in range(len(batch)):
                    for page in connect().get_paginator("list_data_set_revisions").paginate(DataSetId=dataset):
                        rows = [(dataset, r["Id"], r.get("Comment"), pd.to_datetime(r.get("CreatedAt"), utc=True)) for r in page["Revisions"]]
                        yield pd.DataFrame(rows, columns=["dataset_id", "revision_id", "comment", "created_at"]).astype({"created_at": "datetime64[us, UTC]"})

        return stored(self._spark.range(1).mapInPandas(pages, "dataset_id string, revision_id string, comment string, created_at timestamp"), "revisions")

    def assets(self, revisions: DataFrame) -> DataFrame:
        """(revision_id, name, path) of the assets of the given revisions, listed by tasks; a path is dataset/revision/asset."""
        connect, dataset = self._connect, self.dataset_id

        def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for batch in batches:
                for revision in batch["revision_id"]:
                    for page in client.get_paginator("list_revision_assets").paginate(DataSetId=dataset, RevisionId=revision):
                        rows = [(revision, a["Name"], f"{dataset}/{revision}/{a['Id']}") for a in page["Assets"]]
                        yield pd.DataFrame(rows, columns=["revision_id", "name", "path"])

        wanted = revisions.select("revision_id").distinct()
        tasks = max(1, -(-wanted.count() // REVISIONS_PER_TASK))
        return stored(wanted.repartition(tasks).mapInPandas(listing, "revision_id string, name string, path string"), "assets")

    def export(self, bucket: str, prefix: str | None = None, revisions: DataFrame | None = None, at_once: int = JOBS_AT_ONCE) -> int:
        """Has the given revisions, by default the latest, exported to ``<bucket>/<prefix><asset name>``; returns how many.

        Tasks start jobs and wait for them, ``at_once`` together. A task that
        is run again starts its jobs again, which write the same objects.
        Those that fail do not keep others from being tried; then they are an
        error. No revisions given is no job, none in the dataset an error.
        """
        if revisions is None:
            latest = latest_revision(self.revisions())
            if latest is None:
                raise FolioError(f"no revisions in the dataset {self.dataset_id}")
            revisions = self._spark.createDataFrame([(latest,)], "revision_id string")
        connect, dataset, poll, pattern = self._connect, self.dataset_id, self._poll, key_pattern(prefix)

        def jobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for batch in batches:
                for revision in batch["revision_id"]:
                    where = {"Bucket": bucket, "KeyPattern": pattern, "RevisionId": revision}
                    details = {"ExportRevisionsToS3": {"DataSetId": dataset, "RevisionDestinations": [where]}}
                    job = client.create_job(Type="EXPORT_REVISIONS_TO_S3", Details=details)["Id"]
                    client.start_job(JobId=job)
                    why = None
                    try:
                        finished_job(lambda: client.get_job(JobId=job), poll)  # noqa: B023
                    except FolioError as error:
                        why = str(error)
                    yield pd.DataFrame({"revision_id": [revision], "why": pd.Series([why], dtype=object)})

        done = stored(revisions.select("revision_id").distinct().repartition(at_once).mapInPandas(jobs, "revision_id string, why string"), "exports")
        try:
            n = done.agg(F.count("*").alias("n"), F.count("why").alias("failed"), F.min("why").alias("why")).first()
        finally:
            discard(done)
        if n["failed"]:
            raise FolioError(f"{n['failed']} of {n['n']} exports failed, one of them as {n['why']}")
        return n["n"]

    def auto_export(self, bucket: str, prefix: str | None = None) -> str:
        """Has the marketplace export each revision as it is published; returns the id of that action."""
        to = {"ExportRevisionToS3": {"RevisionDestination": {"Bucket": bucket, "KeyPattern": key_pattern(prefix)}}}
        action = self._connect().create_event_action(Action=to, Event={"RevisionPublished": {"DataSetId": self.dataset_id}})["Id"]
        log.info("dataset %s: created event action %s", self.dataset_id, action)
        return action

    def stop_auto_exports(self) -> int:
        """Ends all such exports of this dataset, and of no other; returns how many there were.

        All pages are read before the first action goes, as a listing need not
        hold while what it lists is deleted.
        """
        client = self._connect()
        of_dataset = lambda action: action.get("Event", {}).get("RevisionPublished", {}).get("DataSetId") == self.dataset_id
        own = [a["Id"] for page in client.get_paginator("list_event_actions").paginate() for a in page["EventActions"] if of_dataset(a)]
        for action in own:
            client.delete_event_action(EventActionId=action)
            log.info("dataset %s: deleted event action %s", self.dataset_id, action)
        return len(own)
