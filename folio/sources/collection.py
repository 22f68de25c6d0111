"""Writing collections of objects, in the layout that ``Catalog`` reads."""

from __future__ import annotations

import json
from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.catalog import PARQUET
from folio.sources.files import Files


def write_collection(spark: SparkSession, root: str, kind: str, objects: DataFrame, channels: Mapping[str, DataFrame]) -> None:
    """Writes an object for each row (key, id) of ``objects``, with the rows of each channel that have its key.

    Keys are ``<folders>/<kind>``, the places of the manifests. An object
    without rows in a channel lacks it. The files are written by tasks and
    named by the driver, so this is for collections of some thousands of
    objects: examples, tests and what is moved by hand.
    """
    files, staging = Files(spark), f"{root}/.staging-{uuid4().hex}"
    known = [(r["key"], r["id"]) for r in objects.select("key", "id").orderBy("key").collect()]
    at = {key: i for i, (key, _) in enumerate(known)}
    numbers = F.broadcast(spark.createDataFrame([(k, i) for k, i in at.items()], "key string, _object long"))
    entries: dict[str, list[dict]] = {key: [] for key in at}
    for name, rows in channels.items():
        numbered = rows.join(numbers, "key").drop("key")
        # a task for each object, so a file for each
        numbered.repartition(max(1, len(known)), "_object").write.partitionBy("_object").parquet(f"{staging}/{name}")
        for path in files.list(f"{staging}/{name}"):
            number = path.rsplit("_object=", 1)[-1]
            if number.isdigit():
                key = known[int(number)][0]
                (part,) = [p for p in files.list(path) if p.endswith(".parquet")]
                place = f"{key.rsplit('/', 1)[0]}/{name}"
                files.move(part, f"{root}/{place}")
                columns = [{"name": c} for c in rows.columns if c != "key"]
                entries[key].append({"channel": name, "key": place, "contentType": PARQUET, "columns": columns})
    for key, object_id in known:
        files.publish(f"{root}/{key}", json.dumps({"id": object_id, "key": key, "channels": entries[key]}))
    files.delete(staging)
