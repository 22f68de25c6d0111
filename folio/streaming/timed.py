"""Redelivery as state: a message that is left waits its own time in the stream's state.

Each message is a group of its own in a stateful operator. What is not
acknowledged is kept in the group's state with the number of its deliveries,
and a timer of the operator delivers it again, after the message's own delay.
State and timers are written with the stream's checkpoint, so that a stream
that is started again goes on where it was; there are no tables of messages
that wait.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folio.sources.files import Files
from folio.streaming.queue import ACK, FORCED, acknowledged, delivered, json_translator

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The attribute of a message that has the seconds until it is delivered again.
DELAY = "visibility_seconds"
DEAD = "dead"
_OUT = "MessageId string, ReceiptHandle string, outcome string, error string, deliveries int, handled_at timestamp"
log = logging.getLogger(__name__)

Handler = Callable[[object, dict], object]


class _Deliveries(StatefulProcessor):
    """One message: handed over when it comes and, until it is acknowledged, when its timer ends."""

    def __init__(self, handler: Handler, on_error: Callable[[Exception, dict], object] | None, max_deliveries: int, visibility_seconds: float) -> None:
        self._handler, self._on_error, self._max, self._visibility = handler, on_error, max_deliveries, visibility_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waits = handle.getValueState("waits", "raw string, content string, deliveries int")

    def _hand_over(self, raw: dict, content: str | None, before: int) -> pd.DataFrame:
        outcome, error = delivered(self._handler, self._on_error, content, raw)
        deliveries = before + 1
        if outcome in (ACK, FORCED):
            self._waits.clear()
        elif deliveries >= self._max:
            self._waits.clear()
            error = error or outcome
            outcome = DEAD
        else:
            self._waits.update((json.dumps(raw), content, deliveries))
            delay = (raw.get("attributes") or {}).get(DELAY)
            try:
                seconds = float(delay) if delay is not None else self._visibility
            except ValueError:
                seconds = self._visibility
            self._handle.registerTimer(int((time.time() + seconds) * 1000))
        return pd.DataFrame([(raw.get("MessageId"), raw.get("ReceiptHandle"), outcome, error, deliveries, pd.Timestamp.now(tz="UTC"))], columns=[x.split()[0] for x in _OUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch.to_dict("records"):
                raw = json.loads(row["raw"])
                held = self._waits.get() if self._waits.exists() else None
                if held is not None:  # the queue gave it out again meanwhile: its new handle counts, its timer stays
                    self._waits.update((row["raw"], row["content"], held[2]))
                    continue
                yield self._hand_over(raw, row["content"] if isinstance(row["content"], str) else None, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._waits.exists():
            raw, content, deliveries = self._waits.get()
            yield self._hand_over(json.loads(raw), content, deliveries)

    def close(self) -> None:
        pass


def keyed(messages: DataFrame, translator: Callable[[DataFrame], DataFrame] = json_translator) -> DataFrame:
    """(message, raw, content): messages by what tells them apart, as JSON, with their decoded content."""
    columns = messages.columns
    raw = F.to_json(F.struct(*columns))
    told = F.coalesce(F.concat(F.lit("id:"), "MessageId"), F.concat(F.lit("handle:"), "ReceiptHandle"), F.concat(F.lit("row:"), F.sha2(raw, 256)))
    return translator(messages).select(told.alias("message"), raw.alias("raw"), F.to_json("content").alias("content"))


class TimedConsumer:
    """Consumes a stream of messages with a handler; what is left is delivered again after its own time.

    A message's attribute ``visibility_seconds`` tells its delay, else
    ``visibility_seconds`` of the consumer. Outcomes are written below
    ``root/outcomes``, a folder for each batch that had any, each with the
    number of the delivery; after ``max_deliveries`` a message's outcome is
    'dead'. ``delete`` gets the acknowledged ones of a batch, and may get them
    again. The shuffle partitions of the session are the tasks that handle a
    batch.
    """

    def __init__(
        self,
        spark: SparkSession,
        messages: DataFrame,
        handler: Handler,
        root: str,
        translator: Callable[[DataFrame], DataFrame] = json_translator,
        on_error: Callable[[Exception, dict], object] | None = None,
        delete: Callable[[DataFrame], None] | None = None,
        max_deliveries: int = 5,
        visibility_seconds: float = 30.0,
        poll_seconds: float = 1.0,
    ) -> None:
        if max_deliveries < 1:
            raise ValueError("max_deliveries must be 1 or more")
        self._spark, self._messages, self.root, self._translator, self._delete, self._poll = spark, messages, root.rstrip("/"), translator, delete, poll_seconds
        self._processor = _Deliveries(handler, on_error, max_deliveries, visibility_seconds)
        self._batch = threading.Lock()
        self._files = Files(spark)
        self._query: StreamingQuery | None = None

    def outcomes(self) -> DataFrame:
        """Every delivery so far, with the batch that it was in."""
        return self._spark.read.schema(f"{_OUT}, batch long").parquet(f"{self.root}/outcomes")

    def _sink(self, rows: DataFrame, batch: int) -> None:
        with self._batch:
            path, beside = f"{self.root}/outcomes/batch={batch}", f"{self.root}/_staging/batch={batch}"
            rows.where("outcome is not null").write.mode("overwrite").parquet(beside)  # once: reading it hands nothing over again
            if self._spark.read.schema(_OUT).parquet(beside).isEmpty():
                self._files.delete(beside)
                return
            self._files.delete(path)  # of a batch that is run again
            self._files.move(beside, path)  # whole, so that a reader sees no part of a batch
            if self._delete is not None:
                done = self._spark.read.schema(_OUT).parquet(path)
                self._delete(acknowledged(done).select("MessageId", "ReceiptHandle", "outcome", "error"))

    def start(self) -> StreamingQuery:
        """Starts consuming and returns at once. Timers need a state store that Spark keeps in RocksDB, which this stream gets."""
        messages = keyed(self._messages, self._translator)
        handed = messages.groupBy("message").transformWithStateInPandas(self._processor, _OUT, "append", "processingTime")
        writer = handed.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self._sink).trigger(processingTime=f"{self._poll} seconds")
        before = self._spark.conf.get(PROVIDER, None)
        self._spark.conf.set(PROVIDER, ROCKS)
        try:
            self._query = writer.start()  # keeps the session's settings of this moment
        finally:
            if before is None:
                self._spark.conf.unset(PROVIDER)
            else:
                self._spark.conf.set(PROVIDER, before)
        return self._query

    def stop(self, wait_seconds: float | None = None) -> bool:
        """Stops after the batch that is writing its outcomes; returns whether none was broken off."""
        ended = self._batch.acquire(timeout=-1 if wait_seconds is None else wait_seconds)
        try:
            if self._query is not None and self._query.isActive:
                self._query.stop()
        finally:
            if ended:
                self._batch.release()
        return ended
