import json
import sys
import threading
import time
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException

from folio.errors import FolioError, ForceAcknowledge
from folio.sources.revisions import RevisionExporter, copy_range, finished_job, join_ranges, latest_revision, listed, revisions_between
from folio.streaming.queue import MESSAGE, QueueConsumer, polled, queue_url

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test's module


def handler(content, metadata):
    assert "Body" not in metadata and metadata["MessageId"]
    if content == {"do": "raise"}:
        raise RuntimeError("no")
    if content == {"do": "force"}:
        raise ForceAcknowledge
    return content != {"do": "leave"}


def write(folder, name, bodies):
    rows = [{"MessageId": f"{name}{i}", "ReceiptHandle": None if b == "{}" else f"h{i}", "Body": b, "attributes": {}} for i, b in enumerate(bodies)]
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def test_consumer(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox, "a", ['{"do": "fine"}', '{"do": "leave"}', '{"do": "raise"}', '{"do": "force"}', "{bad", "null", "{}", "0"])
    deleted = []
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(str(inbox))
    consumer = QueueConsumer(spark, stream, handler, str(tmp_path / "q"), delete=lambda df: deleted.append(sorted(r["MessageId"] for r in df.collect())), max_deliveries=2, concurrency=2, backoff_seconds=0.2)
    consumer.run(available_now=True)
    outcomes = {r["MessageId"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "q/outcomes")).where("batch = 0").collect()}
    assert outcomes == {"a0": "ack", "a1": "nack", "a2": "failed", "a3": "forced_ack", "a4": "poison", "a5": "poison", "a6": "ack", "a7": "ack"}
    assert deleted[0] == ["a0", "a3", "a7"]  # no handle, nothing to delete by
    # delivered again though nothing came since
    assert sorted(r["MessageId"] for r in spark.read.parquet(str(tmp_path / "q/dead")).collect()) == ["a1", "a2", "a4", "a5"]
    write(inbox, "b", ['{"do": "fine"}'])
    consumer.run(available_now=True)
    assert deleted[-1] == ["b0"]


def test_messages_without_an_id_are_delivered_again(spark, tmp_path):
    rows = spark.createDataFrame([(None, "h1", '{"do": "leave"}', {"x": "1"}), (None, "h2", '{"do": "fine"}', {})], MESSAGE)
    consumer = QueueConsumer(spark, rows, lambda content, metadata: content == {"do": "fine"}, str(tmp_path), max_deliveries=2)
    consumer.run_batch(rows, 0)
    left = spark.read.parquet(str(tmp_path / "redelivery/batch=0")).collect()
    assert [(r["MessageId"], r["ReceiptHandle"], r["attributes"], r["deliveries"]) for r in left] == [(None, "h1", {"x": "1"}, 1)]
    consumer.run_batch(rows.limit(0), 1)
    assert [r["ReceiptHandle"] for r in spark.read.parquet(str(tmp_path / "dead/batch=1")).collect()] == ["h1"]
    consumer.run_batch(rows.limit(0), 2)
    assert not (tmp_path / "outcomes/batch=2").exists()


def test_errors_of_delivery_end_the_run(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox, "a", ["0"])

    def broken(df):
        raise RuntimeError("no table")

    consumer = QueueConsumer(spark, spark.readStream.schema(MESSAGE).json(str(inbox)), handler, str(tmp_path / "q"), delete=broken)
    with pytest.raises(PySparkException, match="no table"):
        consumer.run(available_now=True)


def test_polled_queue(spark, tmp_path):
    """A queue of files: what is received stays until it is deleted."""
    box = tmp_path / "box"
    box.mkdir()
    for i in range(3):
        (box / f"m{i}").write_text(json.dumps({"n": i}))
    seen = tmp_path / "seen"

    class Client:
        def resolve(self, name):
            return f"file://{name}"

        def receive(self, url, wait_seconds, max_messages, **more):
            seen.write_text(json.dumps([url, wait_seconds, max_messages, more]))
            found = sorted(box.iterdir())[:max_messages]
            if not found:
                time.sleep(wait_seconds)
            return [{"MessageId": p.name, "ReceiptHandle": str(p), "Body": p.read_text(), "Attributes": {"a": 1}} for p in found]

    def delete(df):
        from pathlib import Path

        for r in df.collect():
            Path(r["ReceiptHandle"]).unlink(missing_ok=True)

    stream = polled(spark, Client, "jobs", {"wait_seconds": 0.1, "max_messages": 2, "more": "All"})
    consumer = QueueConsumer(spark, stream, lambda content, metadata: json.loads(metadata["attributes"]["Attributes"]) == {"a": 1} if isinstance(metadata["attributes"], dict) else True, str(tmp_path / "q"), delete=delete, backoff_seconds=0.2)
    thread = threading.Thread(target=consumer.run)
    thread.start()
    for _ in range(150):
        if not list(box.iterdir()):
            break
        time.sleep(0.2)
    assert consumer.stop() and not list(box.iterdir())
    thread.join(30)
    assert not thread.is_alive() and json.loads(seen.read_text()) == ["file://jobs", 0.1, 2, {"more": "All"}]


def test_batch_runs_again_without_harm(spark, tmp_path):
    rows = spark.createDataFrame([("m", "h", '{"do": "raise"}', {})], MESSAGE)
    consumer = QueueConsumer(spark, rows, handler, str(tmp_path), on_error=lambda err, raw: raw["Body"] is not None)
    for _ in range(2):
        consumer.run_batch(rows, 0)
    done = spark.read.parquet(str(tmp_path / "outcomes")).collect()
    assert [(r["outcome"], r["error"]) for r in done] == [("ack", "RuntimeError: no")]
    with pytest.raises(ValueError):
        QueueConsumer(spark, rows, handler, str(tmp_path), concurrency=0)


def test_queue_url():
    assert queue_url("https://x/q", lambda n: "other") == "https://x/q" and queue_url("q", lambda n: f"https://x/{n}") == "https://x/q"


def test_revisions(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    for name in ("a", "b", "c"):
        (source / name).write_text(name)
    revisions = spark.createDataFrame([("d", "r1", "2022-01-01T00", 1), ("d", "r2", "2022-01-02", 2), ("d", "r3", "not a day", 3)], "dataset_id string, revision_id string, comment string, created_at long")
    assets = spark.createDataFrame([(r, f"{r}/{n}", str(source / n)) for r, n in (("r1", "a"), ("r2", "b"), ("r3", "c"))], "revision_id string, name string, path string")
    assert [r["revision_id"] for r in revisions_between(revisions, "2022-01-01", "2022-01-02").collect()] == ["r1"]
    assert latest_revision(revisions) == "r3" and latest_revision(revisions.limit(0)) is None
    out = RevisionExporter(spark, revisions, assets, str(tmp_path / "out"), "p")
    assert out.export() == 1 and out.export() == 0 and (tmp_path / "out/p/r3/c").read_text() == "c"
    assert out.export_between() == 2 and (tmp_path / "out/p/r1/a").exists()
    with pytest.raises(FolioError):
        RevisionExporter(spark, revisions.limit(0), assets, str(tmp_path)).export()
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text('{"revision_id": "r2"}')
    auto = RevisionExporter(spark, revisions, assets, str(tmp_path / "auto"))
    query = auto.start_auto_export(spark.readStream.schema("revision_id string").json(str(feed)), str(tmp_path / "ck"))
    query.processAllAvailable()
    assert (tmp_path / "auto/r2/b").exists() and auto.stop_auto_export() == 1 and auto.stop_auto_export() == 0


def test_large_assets_are_copied_by_ranges_and_taken_up_again(spark, tmp_path, monkeypatch):
    body = bytes(range(256)) * 4_000 + b"end"
    (tmp_path / "src").mkdir()
    (tmp_path / "src/large").write_bytes(body)
    (tmp_path / "src/small").write_bytes(b"s")
    assets = spark.createDataFrame([("r1", "deep/large", str(tmp_path / "src/large")), ("r1", "deep/large", str(tmp_path / "src/large")), ("r1", "small", f"file:{tmp_path / 'src/small'}")], "revision_id string, name string, path string")
    revisions = spark.createDataFrame([("d", "r1", "2022-01-01", datetime(2022, 1, 1))], "dataset_id string, revision_id string, comment string, created_at timestamp")
    out = tmp_path / "out"
    exporter = RevisionExporter(spark, revisions, assets, str(out), range_bytes=100_000)
    ranges = [(at, min(100_000, len(body) - at)) for at in range(0, len(body), 100_000)]
    target = str(out / "deep/large")
    # a run that was broken off after three ranges: these are not copied again, and no reader sees the target
    (out / "deep").mkdir(parents=True)
    assert all(copy_range(str(tmp_path / "src/large"), target, len(body), *r) for r in ranges[:3])
    assert not copy_range(str(tmp_path / "src/large"), target, len(body), *ranges[1]) and not (out / "deep/large").exists()
    with pytest.raises(OSError, match="lacks 8 ranges"):
        join_ranges(str(tmp_path / "src/large"), target, len(body), 100_000)
    assert exporter.export() == 2 and (out / "deep/large").read_bytes() == body and (out / "small").read_bytes() == b"s"
    assert exporter.export() == 0 and sorted(p.name for p in (out / "deep").iterdir()) == ["large"]
    assert not copy_range(str(tmp_path / "src/large"), target, len(body), *ranges[0])


def test_export_jobs():
    states = iter(["WAITING", "IN_PROGRESS", "COMPLETED"])
    assert finished_job(lambda: {"Id": 1, "State": next(states)}, 0)["State"] == "COMPLETED"
    for job, why in (({"Id": 7, "State": "ERROR", "Errors": [{"Message": "no room"}]}, "job 7 failed: no room"), ({"Id": 8, "State": "CANCELLED"}, "job 8 was cancelled"), ({"Id": 9, "State": "TIMED_OUT"}, "job 9 timed out")):
        with pytest.raises(FolioError, match=why):
            finished_job(lambda: job, 0)  # noqa: B023


def test_revisions_of_a_folder(spark, tmp_path):
    for day in ("2022-01-01T00", "2022-02-01T00"):
        (tmp_path / "src" / day / "deep").mkdir(parents=True)
        (tmp_path / "src" / day / "deep" / "a.bin").write_text(day)
        (tmp_path / "src" / day / "b.bin").write_text("b")
    revisions, assets = listed(spark, str(tmp_path / "src"), "d")
    assert sorted((r["revision_id"], r["name"]) for r in assets.collect()) == [(d, n) for d in ("2022-01-01T00", "2022-02-01T00") for n in ("b.bin", "deep/a.bin")]
    out = RevisionExporter(spark, revisions, assets, str(tmp_path / "out"))
    assert out.export_between("2022-02") == 2 and (tmp_path / "out/deep/a.bin").read_text() == "2022-02-01T00"
