"""Keyed state over time as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.urls import normalize_url
from ..sources.io import read_results_jsonl


def stream_results_to_table(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all result files not seen yet to a parquet table and stops; the checkpoint makes it resumable."""
    stream = read_results_jsonl(spark, source, streaming=True)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_results_by_session(stream: DataFrame, out: str, checkpoint: str, run: str = "main", by: str = "sessionId") -> StreamingQuery:
    """JSON lines of a stream in folders run=<run>/batch_id=<n>/<by>=<session>, written once however often a batch is tried.

    A micro-batch owns the folder of its number and replaces it as a whole, so a batch that is run again after a failure
    leaves the same lines. A stream that starts over without its checkpoint counts from 0: give it another `run`. Null
    sessions go to Spark's default partition; a batch without rows leaves an empty folder. Read with read_sessions().
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.partitionBy(by).mode("overwrite").json(f"{out}/run={run}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sessions(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    """What stream_results_by_session() wrote, with run, batch_id and the session column."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", out).json(f"{out}/run=*/batch_id=*")


def stream_request_counters(stream: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes", slide: str | None = None, ts: str = "ts", by: str = "job_id", error_class: str | None = None) -> DataFrame:
    """Counters per job and time bucket (start, end): total, failed and response times; late rows beyond the watermark are dropped by Spark.

    With `error_class`, the column of the class, also error_classes: a map of the failed rows by class. Two stateful
    aggregates then stand in a row, by bucket, job and class and by bucket and job, which streams write in append mode:
    a bucket appears once the watermark has passed its end. Failed rows of no class count under 'unknown'.
    """
    bucket = F.window(ts, window, slide) if slide else F.window(ts, window)
    ok = F.coalesce("success", F.lit(False))
    rows, measures = stream.withWatermark(ts, watermark), [F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("failed"), F.min("response_time_ms").alias("min_ms"), F.max("response_time_ms").alias("max_ms")]
    names = [F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "total", "failed", "min_ms", "max_ms", "avg_ms"]
    if error_class is None:
        return rows.groupBy(bucket.alias("w"), by).agg(*measures, F.avg("response_time_ms").alias("avg_ms")).select(*names)
    kind = F.when(~ok, F.coalesce(F.col(error_class), F.lit("unknown")))
    parts = rows.groupBy(bucket.alias("w"), by, kind.alias("_class")).agg(*measures, F.sum("response_time_ms").alias("_sum"), F.count("response_time_ms").alias("_n"))
    counts = F.sort_array(F.collect_list(F.when(F.col("_class").isNotNull(), F.struct("_class", "failed"))))
    out = parts.groupBy("w", by).agg(
        F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("avg_ms"), F.map_from_entries(counts).alias("error_classes")
    )
    return out.select(*names, "error_classes")


def stream_dedupe_urls(stream: DataFrame, watermark: str = "1 hour", ts: str = "ts", col: str = "url") -> DataFrame:
    """The first row of each normal form of a URL within the watermark."""
    rows = stream.withColumn("normalized", normalize_url(F.col(col))).filter("normalized is not null")
    return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["normalized"])


def stream_session_progress(stream: DataFrame, ttl: str = "24 hours", ts: str = "ts") -> DataFrame:
    """Per session within its time to live: processed, failed, last index."""
    ok = F.coalesce("success", F.lit(False))
    return stream.withWatermark(ts, ttl).groupBy(F.session_window(ts, ttl).alias("w"), "sessionId").agg(F.count(F.lit(1)).alias("processed"), F.count_if(~ok).alias("failed"), F.max("idx").alias("last_index"), F.max(ts).alias("updated_at")).drop("w")


class SessionProgress(StatefulProcessor):
    """Counts of one session while it lives: from its first event until the watermark passes its time to live."""

    STATE = "created long, updated long, last_index long, success long, failed long"
    FIELDS = ("sessionId", "status", "processed", "success", "failed", "current_index", "updated_ms", "expires_ms")

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", self.STATE)

    def _row(self, key, status: str) -> pd.DataFrame:
        created, updated, last, success, failed = self.state.get()
        return pd.DataFrame([(key[0], status, success + failed, success, failed, last + 1, updated, created + self.ttl_ms)], columns=self.FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():  # timers run after rows: what has expired by now ends before them
            ends = self.state.get()[0] + self.ttl_ms
            if timerValues.getCurrentWatermarkInMs() >= ends:
                yield self._row(key, "expired")
                self.state.clear()
                self.handle.deleteTimer(ends)
        new = not self.state.exists()
        created, updated, last, success, failed = (1 << 62, -1, -1, 0, 0) if new else self.state.get()
        for frame in rows:
            good = int(frame["success"].sum())
            success, failed = success + good, failed + len(frame) - good
            created = min(created, int(frame["ms"].min())) if new else created
            newest, index = max(zip(frame["ms"].tolist(), frame["idx"].tolist()))
            updated, last = max((updated, last), (newest, index))
        self.state.update((created, updated, last, success, failed))
        if new:
            self.handle.registerTimer(created + self.ttl_ms)
        yield self._row(key, "active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, "expired")
        self.state.clear()

    def close(self) -> None:
        pass


def stream_sessions(stream: DataFrame, ttl_ms: int = 24 * 3_600_000, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(sessionId, status, processed, success, failed, current_index, updated_ms, expires_ms) of a stream (sessionId, success, idx, ts).

    A session that got rows in a micro-batch gives an 'active' row of its counts so far; current_index follows the index
    of its latest row. Once the watermark is past its first row's time and the time to live, it gives an 'expired' row and
    its state goes; a row that comes later begins a new session of that name. State holds five numbers a session. Rows
    without session or time are dropped; null success is a failure, a null index counts as -1. Needs
    spark.sql.streaming.stateStore.providerClass set to the RocksDB provider; write in update mode.
    """
    if "RocksDB" not in stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to Spark's RocksDBStateStoreProvider")
    rows = stream.withWatermark(ts, watermark).filter(F.col("sessionId").isNotNull() & F.col(ts).isNotNull())
    rows = rows.select("sessionId", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce(F.col("idx").cast("long"), F.lit(-1)).alias("idx"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), ts)
    fields = "sessionId string, status string, processed long, success long, failed long, current_index long, updated_ms long, expires_ms long"
    return rows.groupBy("sessionId").transformWithStateInPandas(SessionProgress(ttl_ms), fields, "Update", "EventTime")
