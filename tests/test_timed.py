"""Messages that are left wait their own time in the stream's state."""

import json
import sys
import time

import pytest
from pyspark import cloudpickle

from folio.errors import ForceAcknowledge
from folio.streaming.queue import MESSAGE, delivered
from folio.streaming.timed import DELAY, PROVIDER, TimedConsumer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test's module


def handler(content, metadata):
    if content == "force":
        raise ForceAcknowledge
    if content == "raise":
        raise RuntimeError("no")
    return content == "fine"


def put(folder, name, messages):
    rows = [{"MessageId": i, "ReceiptHandle": f"h-{i}", "Body": body, "attributes": attributes} for i, body, attributes in messages]
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def wait_for(condition, query, seconds=150):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception() is not None:
            raise query.exception()
        if condition():
            return
        time.sleep(0.5)
    raise AssertionError("waited in vain")


def test_each_message_waits_its_own_time(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a", [("soon", '"leave"', {DELAY: "0.5"}), ("late", '"leave"', {DELAY: "12"}), ("ok", '"fine"', {}), ("bad", "{broken", {DELAY: "0.2"}), ("forced", '"force"', {})])
    deleted = []
    stream = spark.readStream.schema(MESSAGE).json(str(inbox))
    before = spark.conf.get(PROVIDER)
    consumer = TimedConsumer(spark, stream, handler, str(tmp_path / "q"), delete=lambda df: deleted.extend(r["MessageId"] for r in df.collect()), max_deliveries=3, poll_seconds=0.2)
    query = consumer.start()
    assert spark.conf.get(PROVIDER) == before
    rows = lambda: consumer.outcomes().collect() if (tmp_path / "q/outcomes").exists() else []
    times = lambda name: [(r["handled_at"], r["outcome"], r["deliveries"]) for r in sorted(rows(), key=lambda r: r["deliveries"]) if r["MessageId"] == name]
    wait_for(lambda: len(times("late")) >= 1 and len(times("soon")) == 3, query)
    assert [x[1:] for x in times("soon")] == [("nack", 1), ("nack", 2), ("dead", 3)]
    # stopped with a message in its state, and started again
    assert consumer.stop()
    again = TimedConsumer(spark, stream, handler, str(tmp_path / "q"), delete=lambda df: deleted.extend(r["MessageId"] for r in df.collect()), max_deliveries=3, poll_seconds=0.2)
    put(inbox, "b", [("soon", '"fine"', {})])
    query = again.start()
    wait_for(lambda: len(times("late")) >= 2 and len(times("soon")) == 4, query)
    again.stop()
    late = times("late")
    assert (late[1][0] - late[0][0]).total_seconds() >= 12 and late[1][1:] == ("nack", 2)
    assert [x[1:] for x in times("bad")] == [("poison", 1), ("poison", 2), ("dead", 3)]
    assert [x[1:] for x in times("ok")] == [("ack", 1)] and [x[1:] for x in times("forced")] == [("forced_ack", 1)]
    assert sorted(set(deleted)) == ["forced", "ok", "soon"]
    assert {p.name for p in (tmp_path / "q").iterdir()} <= {"checkpoint", "outcomes", "_staging"}


def test_delivery_of_one_message():
    raw = {"MessageId": "m", "Body": '"x"'}
    assert delivered(handler, None, '"fine"', raw) == ("ack", None) and delivered(handler, None, '"no"', raw) == ("nack", None)
    assert delivered(handler, None, None, raw)[0] == "poison" and delivered(handler, lambda e, r: True, None, raw)[0] == "ack"
    assert delivered(handler, None, '"raise"', raw) == ("failed", "RuntimeError: no")
    outcome, error = delivered(handler, lambda e, r: 1 / 0, '"raise"', raw)
    assert outcome == "failed" and "ZeroDivisionError" in error
    with pytest.raises(ValueError):
        TimedConsumer(None, None, handler, "", max_deliveries=0)
