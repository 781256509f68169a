"""Streams with late rows, restarts and replayed batches."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import stateful as S

SCHEMA = "sessionId string, success boolean, idx long, at long, class string"


class Feed:
    """A folder of JSON files, one a micro-batch."""

    def __init__(self, spark):
        self.spark, self.dir, self.n = spark, tempfile.mkdtemp(prefix="spark-"), 0

    def put(self, *rows):
        import json

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        with open(f"{self.dir}/{self.n:04d}.json", "w") as out:
            out.writelines(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
        os.utime(f"{self.dir}/{self.n:04d}.json", (self.n, self.n))
        self.n += 1

    def stream(self):
        rows = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(self.dir)
        return rows.withColumn("ts", F.timestamp_seconds("at"))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_error_classes_with_late_rows(spark):
    feed, out = Feed(spark), tempfile.mkdtemp(prefix="spark-")
    feed.put(("j", True, 0, 10, None), ("j", False, 0, 20, "a"), ("j", False, 0, 30, "b"), ("k", False, 0, 40, None))
    feed.put(("j", False, 0, 50, "a"), ("j", True, 0, 400, None))
    feed.put(("j", False, 0, 55, "b"), ("j", True, 0, 2000, None))  # late, yet before the watermark
    feed.put(("j", True, 0, 2001, None))  # rows are late by the watermark of the batch before
    feed.put(("j", False, 0, 60, "a"), ("j", True, 0, 5000, None))  # too late: its bucket is closed
    rows = feed.stream().withColumnRenamed("sessionId", "job_id").withColumn("response_time_ms", F.col("at").cast("double"))
    made = S.stream_request_counters(rows, "10 minutes", "5 minutes", error_class="class")
    run(made.writeStream.outputMode("append").format("parquet").option("path", f"{out}/o").option("checkpointLocation", f"{out}/c"))
    feed.put(("j", True, 0, 9000, None))  # restart from the checkpoint closes more buckets
    run(made.writeStream.outputMode("append").format("parquet").option("path", f"{out}/o").option("checkpointLocation", f"{out}/c"))
    got = {(r.job_id, int(r.start.timestamp())): (r.total, r.failed, r.error_classes, r.avg_ms) for r in spark.read.parquet(f"{out}/o").collect()}
    assert got[("j", 0)] == (5, 4, {"a": 2, "b": 2}, 33.0) and got[("k", 0)] == (1, 1, {"unknown": 1}, 40.0)
    assert got[("j", 300)] == (1, 0, {}, 400.0) and ("j", 4800) in got and ("j", 9000) not in got


def test_sessions_expire_and_survive_a_restart(spark, rocks):
    feed, out = Feed(spark), tempfile.mkdtemp(prefix="spark-")
    found = []

    def start():
        made = S.stream_sessions(feed.stream(), ttl_ms=100_000, watermark="10 seconds")
        keep = lambda df, n: found.extend((r.sessionId, r.status, r.processed, r.success, r.failed, r.current_index, r.expires_ms) for r in df.orderBy("sessionId", "status").collect())
        run(made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/c"))

    feed.put(("a", True, 0, 1000, None), ("a", False, 1, 1005, None), ("b", True, 7, 1050, None), (None, True, 0, 1000, None))
    feed.put(("a", True, 2, 1090, None))
    start()
    assert found == [("a", "active", 2, 1, 1, 2, 1_100_000), ("b", "active", 1, 1, 0, 8, 1_150_000), ("a", "active", 3, 2, 1, 3, 1_100_000)]
    found.clear()
    feed.put(("b", None, 3, 1086, None), ("b", True, 4, 1085, None), ("b", True, 5, 1060, None))  # the latest row says the index, not the greatest; one is late
    feed.put(("c", True, 0, 1120, None))  # the watermark passes a's end
    feed.put(("a", True, 9, 1121, None))  # a new session of that name
    start()
    assert ("b", "active", 3, 2, 1, 4, 1_150_000) in found and ("a", "expired", 3, 2, 1, 3, 1_100_000) in found and ("a", "active", 1, 1, 0, 10, 1_221_000) in found, found
    assert sum(f[1] == "expired" for f in found) == 1


def test_sessions_need_their_state_store(spark):
    with pytest.raises(ValueError):
        S.stream_sessions(Feed(spark).stream())


def test_a_batch_that_runs_again_is_written_once(spark):
    feed, out = Feed(spark), tempfile.mkdtemp(prefix="spark-")
    feed.put(("a", True, 0, 1, None), ("b", True, 0, 2, None))
    feed.put(("a", True, 1, 3, None))

    def start():
        query = S.stream_results_by_session(feed.stream(), f"{out}/o", f"{out}/c")
        query.awaitTermination()

    start()
    rows = lambda: sorted((r.sessionId, r.batch_id, r.idx) for r in S.read_sessions(spark, f"{out}/o").collect())
    assert rows() == [("a", 0, 0), ("a", 1, 1), ("b", 0, 0)]
    for name in ("1", ".1.crc"):  # as if the job had died after writing and before the commit
        os.remove(f"{out}/c/commits/{name}")
    feed.put(("c", True, 0, 4, None))
    start()
    assert rows() == [("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("c", 2, 0)]
    start()
    assert len(rows()) == 4
