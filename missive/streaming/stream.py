"""The same analysis over a stream: it keeps no state, so it is the batch plan; windows and ids have watermarks.

Checks that look back over all rows keep what they need between micro-batches: how often each id has occurred (state by id, with timers that
end it), and the greatest timestamp so far (one row a micro-batch, written beside the issues).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import blank
from ..operators.validate import first_inversion
from ..plans.analysis import published
from ..sources.artifacts import ARTIFACTS, exists


def analyzed_stream(messages: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Published rows of a stream of messages (message_id, ts, sender, message, row_pos), each id once within the delay."""
    once = messages.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["message_id"])
    return published(once)


def categories_by_window(results: DataFrame, *, window: str = "1 day") -> DataFrame:
    """Messages of each category in windows of event time."""
    return results.groupBy(F.window("event_time", window).alias("w"), "classification.category").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "category", "n")


def write_artifacts(results: DataFrame, folder: str, checkpoint: str):
    """A query that appends each micro-batch to the artifact tables; a batch that runs again replaces its own part."""

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()
        for name, made in ARTIFACTS.items():
            made(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
        batch.unpersist()

    return results.drop("event_time").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful(spark: SparkSession) -> SparkSession:
    """The session with the state store that state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Occurrences(StatefulProcessor):
    """Of each id how often it has occurred, till nothing has been heard of it for so long."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, until = self.seen.get() if self.seen.exists() else (0, 0)
        for part in rows:
            part = part.sort_values("row_pos")
            number = range(n + 1, n + len(part) + 1)
            n += len(part)
            until = max(until, int(part["event_ms"].max()) + self.keep_ms)
            again = part.assign(occurrence=number).loc[lambda x: x["occurrence"] > 1]
            if len(again):
                yield again[["message_id", "row_pos", "occurrence"]]
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        self.seen.update((n, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def repeated_ids(messages: DataFrame, *, delay: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """(message_id, row_pos, occurrence) of second and later rows of an id, over all micro-batches, as soon as they come.

    Rows of one micro-batch are numbered by row_pos. The state of an id is a number and a time; it ends when the watermark is ``keep_seconds`` of
    event time after the id's last row. Rows of a null id are one id. The session must be ``stateful``.
    """
    timed = messages.withColumn("event_time", F.col("ts").cast("timestamp")).where("event_time is not null").withWatermark("event_time", delay)
    rows = timed.select("message_id", "row_pos", "event_time", F.unix_millis("event_time").alias("event_ms"))
    return rows.groupBy("message_id").transformWithStateInPandas(_Occurrences(keep_seconds * 1000), "message_id string, row_pos long, occurrence long", "append", "EventTime")


def write_issues(messages: DataFrame, folder: str, checkpoint: str):
    """A query that appends the issues of each micro-batch (code, row_pos, message_id): a row before the greatest timestamp so far, blank ids, texts and senders.

    Only the first row out of order of a micro-batch is reported. The greatest timestamp is kept a row a micro-batch; a batch that runs again reads its
    predecessor's row and replaces its own, so a restart changes nothing.
    """
    spark = messages.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        before = spark.read.schema("top timestamp_ntz").parquet(f"{folder}/order/batch={n - 1}") if n and exists(spark, f"{folder}/order/batch={n - 1}") else spark.createDataFrame([], "top timestamp_ntz")
        top = before.agg(F.max("top").alias("top"))
        late = batch.join(F.broadcast(top)).where("ts < top").agg(F.min_by(F.struct("row_pos", "message_id"), "row_pos").alias("x")).where("x is not null").select("x.*")  # top is one row
        inside = first_inversion(batch)
        first = late.unionByName(inside).agg(F.min_by(F.struct("row_pos", "message_id"), "row_pos").alias("x")).where("x is not null").select(F.lit("not_chronological").alias("code"), "x.*")
        rows = [first, *(batch.where(blank(F.col(c))).select(F.lit(code).alias("code"), "row_pos", "message_id") for c, code in (("message_id", "empty_message_id"), ("message", "missing_message_content"), ("sender", "missing_sender")))]
        out = rows[0]
        for x in rows[1:]:
            out = out.unionByName(x)
        out.write.mode("overwrite").parquet(f"{folder}/issues/batch={n}")
        before.unionByName(batch.select(F.col("ts").alias("top"))).agg(F.max("top").alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/order/batch={n}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
