"""Consuming a message queue at least once, as a structured stream.

A stream's offsets cannot be moved back for one message, so that messages that
were not acknowledged go to a redelivery table, which is added to the next
batch, and after ``max_deliveries`` to a table of dead letters. A clock is
united with the messages, so that there is a next batch on a quiet queue too.
Each batch writes its outcomes under its number: a batch that is run again
replaces them.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from folio.errors import ForceAcknowledge
from folio.functions.columns import message_content
from folio.sources.files import Files

MESSAGE = "MessageId string, ReceiptHandle string, Body string, attributes map<string,string>"
ACK, NACK, POISON, FORCED, FAILED = "ack", "nack", "poison", "forced_ack", "failed"
RECEIVE = {"wait_seconds": 20, "max_messages": 1}
log = logging.getLogger(__name__)


def json_translator(messages: DataFrame) -> DataFrame:
    """``messages`` with ``content``: the JSON body as a variant, null where it is malformed, absent or JSON's null."""
    return messages.withColumn("content", message_content(F.col("Body")))


def metadata_of(messages: DataFrame) -> DataFrame:
    """What describes the messages: all columns but the body."""
    return messages.drop("Body")


def has_content(messages: DataFrame) -> Column:
    """Whether a handler gets the message: an empty object, a zero or an empty text count as content."""
    return F.col("content").isNotNull()


def queue_url(queue: str, resolve: Callable[[str], str]) -> str:
    """A queue's address: the name itself if it is one already, else what ``resolve`` knows it by."""
    return queue if "://" in queue else resolve(queue)


class _Poller(DataSourceStreamReader):
    """Each batch polls once in each of some tasks; there is always a next batch."""

    def __init__(self, make_client: Callable[[], object], queue: str, options: Mapping, workers: int, backoff_seconds: float) -> None:
        self._make, self._queue, self._options, self._workers, self._backoff = make_client, queue, dict(options), workers, backoff_seconds

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        return {"polls": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self._workers)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            client = self._make()
            url = queue_url(self._queue, client.resolve)
            got = list(client.receive(url, **self._options))
        except Exception:
            log.exception("receiving failed; the next batch tries again in %s s", self._backoff)
            time.sleep(self._backoff)
            return
        for m in got:
            rest = {k: v if isinstance(v, str) else json.dumps(v) for k, v in m.items() if k not in ("MessageId", "ReceiptHandle", "Body")}
            yield m.get("MessageId"), m.get("ReceiptHandle"), m.get("Body"), rest


def polled(spark: SparkSession, make_client: Callable[[], object], queue: str, options: Mapping | None = None, workers: int = 1, backoff_seconds: float = 1.0) -> DataFrame:
    """A stream of the messages that a queue's client receives, as ``MESSAGE``.

    ``make_client`` is called in each task and gives an object with
    ``resolve(name)`` and ``receive(url, **options)``; ``options`` are added to
    those of ``RECEIVE`` and override them. A message that is received in a
    batch that fails is not deleted, so the queue gives it out again. An error
    in receiving is logged, waited for and leaves the batch empty.
    """
    settings = RECEIVE | dict(options or {})

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return "folio_queue"

        def schema(self) -> str:
            return MESSAGE

        def streamReader(self, schema):
            return _Poller(make_client, queue, settings, workers, backoff_seconds)

    spark.dataSource.register(Polled)
    return spark.readStream.format("folio_queue").load()


def delivered(handler: Callable[[object, dict], object], on_error: Callable[[Exception, dict], object] | None, content: str | None, raw: dict) -> tuple[str, str | None]:
    """(outcome, error) of handing one message over; ``content`` is its decoded body as JSON, None where it has none."""
    outcome, error = POISON, None
    try:
        if content is None:
            raise ValueError("message without content")
        outcome = ACK if handler(json.loads(content), {k: v for k, v in raw.items() if k != "Body"}) else NACK
    except ForceAcknowledge:
        outcome = FORCED
    except Exception as err:
        error = f"{type(err).__name__}: {err}"
        outcome = POISON if content is None else FAILED
        try:
            if on_error is not None and on_error(err, raw):
                outcome = ACK
        except Exception as again:
            error = f"{error}; then {type(again).__name__}: {again}"
    return outcome, error


def _delivered(messages: DataFrame, handler: Callable[[object, dict], object], on_error: Callable[[Exception, dict], object] | None) -> DataFrame:
    """Translated messages with ``outcome`` and ``error`` instead of their content."""

    @F.pandas_udf("outcome string, error string")
    def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            contents = [row.pop("_content") for row in rows]
            out = [delivered(handler, on_error, content if isinstance(content, str) else None, row) for content, row in zip(contents, rows, strict=True)]
            yield pd.DataFrame(out, columns=["outcome", "error"])

    raw = [c for c in messages.columns if c not in ("content", "deliveries")]
    given = F.struct(*raw, F.to_json("content").alias("_content"))
    done = messages.withColumn("_done", deliver.asNondeterministic()(given))  # so that Spark runs it once
    return done.drop("content").select("*", "_done.outcome", "_done.error").drop("_done")


def handled(messages: DataFrame, handler: Callable[[object, dict], object], on_error: Callable[[Exception, dict], object] | None = None) -> DataFrame:
    """(MessageId, ReceiptHandle, outcome, error) of every translated message.

    The handler gets the decoded content and the metadata. A true result
    acknowledges, a false one leaves the message; ``ForceAcknowledge``
    acknowledges; any other error is handed to ``on_error``, whose true result
    acknowledges. Messages without content are poison and go to ``on_error``
    too. An error in one message leaves the others alone.
    """
    return _delivered(messages, handler, on_error).select("MessageId", "ReceiptHandle", "outcome", "error")


def acknowledged(outcomes: DataFrame) -> DataFrame:
    """The messages that are to be deleted: acknowledged, and with a handle to delete them by."""
    return outcomes.where(F.col("outcome").isin(ACK, FORCED) & F.col("ReceiptHandle").isNotNull())


class QueueConsumer:
    """Consumes a stream of messages (columns of ``MESSAGE``) with a handler.

    Tables below ``root``: ``outcomes``, ``redelivery`` and ``dead``, each with
    a folder for every batch that had messages. ``delete`` is called once a
    batch with the acknowledged messages, and may be called again with the
    same ones. ``concurrency`` is the number of tasks that handle a batch; by
    default those in which it came.
    """

    def __init__(
        self,
        spark: SparkSession,
        messages: DataFrame,
        handler: Callable[[object, dict], object],
        root: str,
        translator: Callable[[DataFrame], DataFrame] = json_translator,
        on_error: Callable[[Exception, dict], object] | None = None,
        delete: Callable[[DataFrame], None] | None = None,
        concurrency: int | None = None,
        max_deliveries: int = 5,
        backoff_seconds: float = 1.0,
    ) -> None:
        if concurrency is not None and concurrency < 1:
            raise ValueError("concurrency must be 1 or more")
        self._spark, self._messages, self._handler, self.root = spark, messages, handler, root.rstrip("/")
        self._translator, self._on_error, self._delete = translator, on_error, delete
        self._concurrency, self._max, self._backoff = concurrency, max_deliveries, backoff_seconds
        self._files = Files(spark)
        self._query: StreamingQuery | None = None
        self._stopping = False
        self._batch = threading.Lock()
        self._left = False  # whether the last batch left messages to be delivered again

    def _table(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _waiting(self, batch: int) -> DataFrame | None:
        """What the batch before left to be delivered again."""
        path = self._table("redelivery", batch - 1)
        return self._spark.read.parquet(path) if batch > 0 and self._files.exists(path) else None

    def run_batch(self, fresh: DataFrame, batch: int) -> None:
        """Delivers a batch's messages and those left by the one before; runs again without harm."""
        with self._batch:
            self._left = self._run(fresh, batch)

    def _run(self, fresh: DataFrame, batch: int) -> bool:
        if "_tick" in fresh.columns:
            fresh = fresh.where("_tick is null").drop("_tick")
        fresh = fresh.withColumn("deliveries", F.lit(0))
        left = self._waiting(batch)
        raw = fresh if left is None else fresh.unionByName(left)
        raw = raw.repartition(self._concurrency) if self._concurrency else raw
        done = _delivered(self._translator(raw), self._handler, self._on_error)
        # written once: the handler is not run again by what reads the outcomes
        done.write.mode("overwrite").parquet(self._table("outcomes", batch))
        done = self._spark.read.schema(done.schema).parquet(self._table("outcomes", batch))
        kinds = {r["outcome"] for r in done.select("outcome").distinct().collect()}
        if not kinds:  # the clock only
            self._files.delete(self._table("outcomes", batch))
            return False
        if self._delete is not None:
            self._delete(acknowledged(done).select("MessageId", "ReceiptHandle", "outcome", "error"))
        again = done.where(~F.col("outcome").isin(ACK, FORCED)).withColumn("deliveries", F.col("deliveries") + 1)
        again = again.select(*raw.columns)
        again.where(F.col("deliveries") < self._max).write.mode("overwrite").parquet(self._table("redelivery", batch))
        again.where(F.col("deliveries") >= self._max).write.mode("overwrite").parquet(self._table("dead", batch))
        if batch > 1:
            self._files.delete(self._table("redelivery", batch - 2))
        return not self._waiting(batch + 1).isEmpty()

    def start(self, available_now: bool = False) -> StreamingQuery:
        """Starts consuming and returns at once."""
        clock = self._spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(True).alias("_tick"))
        stream = self._messages.unionByName(clock, allowMissingColumns=True)
        writer = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self.run_batch)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self._backoff} seconds")
        self._query = writer.start()
        return self._query

    def run(self, available_now: bool = False, restarts: int = 10) -> None:
        """Consumes until stopped, with ``available_now`` until nothing is left to be delivered.

        After a failure of the source it waits and goes on, up to ``restarts``
        times. A failure in delivering (not of a handler, whose errors are
        outcomes) is raised at once.
        """
        failures = 0
        while not self._stopping:
            try:
                self.start(available_now).awaitTermination()
                if not available_now or not self._left:
                    return
            except PySparkException as err:
                failures += 1
                if failures > restarts or "FOREACH_BATCH_USER_FUNCTION_ERROR" in f"{err.getCondition()} {err}":
                    raise
                log.exception("receiving failed; trying again in %s s", self._backoff)
            time.sleep(self._backoff)

    def stop(self, wait_seconds: float | None = None) -> bool:
        """Stops after the batch that is running; after ``wait_seconds`` it is broken off, and run again by the next start.

        Returns whether no batch was broken off.
        """
        self._stopping = True
        ended = self._batch.acquire(timeout=-1 if wait_seconds is None else wait_seconds)
        try:
            if self._query is not None and self._query.isActive:
                self._query.stop()
        finally:
            if ended:
                self._batch.release()
        return ended
