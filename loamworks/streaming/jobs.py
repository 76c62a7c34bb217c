"""Streaming forms of the operators. Late data follow Spark's rules: what comes after the watermark is dropped from windowed state."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert


def file_stream(spark: SparkSession, path: str, like: str, per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files as they land in a folder, with the columns of the file or folder ``like``."""
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """``events`` with an instant as event time; a stream gets the watermark."""
    own = events.withColumn(time, F.col(time).cast("timestamp"))
    return own.withWatermark(time, late) if events.isStreaming else own


def hourly(events: DataFrame, time: str, key: str, value: str, late: str = "3 days") -> DataFrame:
    """(hour, key, n, total, largest) by event time, for streams and tables alike."""
    return timed(events, time, late).groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.max(value).alias("largest")).select(F.col("w.start").alias("hour"), key, "n", "total", "largest")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events with no longer pause than ``gap``."""
    return timed(events, time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def unseen(pages: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Each key and content hash once within the watermark; a table keeps one row a key."""
    if not pages.isStreaming:
        return pages.dropDuplicates(keys)
    return timed(pages, time, late).dropDuplicatesWithinWatermark(keys)


def attempt_counters(events: DataFrame, key: str, success: str, time: str, ttl: str = "14 days", late: str = "1 day") -> DataFrame:
    """(key, attempts, successes) so far after each batch; a key's state ends ``ttl`` of event time after its last event.

    Rows without a key and rows later than ``late`` are left out. The state of a key is two numbers and a time.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def count(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts, successes = state.get if state.exists else (0, 0)
        last = 0
        for pdf in batches:
            attempts += len(pdf)
            successes += int(pdf["success"].sum())
            last = max(last, int(pdf["at"].max().timestamp() * 1000))
        state.update((attempts, successes))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [group[0]], "attempts": [attempts], "successes": [successes]})

    own = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(success), F.lit(False)).alias("success"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    return own.groupBy("key").applyInPandasWithState(count, "key string, attempts long, successes long", "attempts long, successes long", "update", "EventTimeTimeout")


def counted_attempts(events: DataFrame, key: str, success, time: str, now, days: int = 14) -> DataFrame:
    """(key, attempts, successes) of a table's events of the last ``days`` before ``now``, as the stream's counters would hold them; a null key counts nowhere."""
    recent = events.where(F.col(key).isNotNull() & (F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS")))
    return recent.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("attempts"), F.count_if(success).alias("successes"))


def skip_layers(counters: DataFrame, least: int = 30, share: float = 0.35) -> DataFrame:
    """Keys whose costly layers are skipped: enough attempts and too few successes."""
    return counters.where((F.col("attempts") >= least) & (F.col("successes") < share * F.col("attempts")))


class Ratchet:
    """A keyed table kept as one Parquet folder a batch; each batch is merged into the last by ``rules``.

    A batch number seen before rewrites its own folder, so a repeated batch changes nothing.
    """

    def __init__(self, folder: str, keys: list[str], rules: dict[str, str], reduce: Callable[[DataFrame], DataFrame]):
        self.folder, self.keys, self.rules, self.reduce = folder, keys, rules, reduce
        self.last: int | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = self.reduce(batch)
        before = self.last if self.last is None or self.last < number else number - 1
        if before is not None and before >= 0:
            new = upsert(batch.sparkSession.read.parquet(f"{self.folder}/{before}"), new, self.keys, self.rules)
        new.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.last = number

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{self.last}")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Works through what has landed, in batches, and ends."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def gone(last_seen: DataFrame, key: str, time: str, now, days: int = 7) -> DataFrame:
    """Keys unseen for so many days before ``now``."""
    return last_seen.groupBy(key).agg(F.max(time).alias("last_seen")).where(F.col("last_seen") < now - F.expr(f"INTERVAL {days} DAYS"))


def claim_order(queue: DataFrame, n: int) -> DataFrame:
    """The next ``n`` pending rows by priority, age and id."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), F.asc("added_at"), F.asc("id")).limit(n)


def worker_change(depth, workers):
    """One worker more from 200 waiting rows on, one less up to 20, never below one."""
    return F.when(depth >= 200, workers + 1).when(depth <= 20, F.greatest(workers - 1, F.lit(1))).otherwise(workers)
