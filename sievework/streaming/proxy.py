"""The request stream: actions, suppression of repeats, windows, and a verdict cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sievework.operators.serve import action

#: Setting and value of the state store that cached() needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
REQUEST = "event_id long, ts timestamp, key string, kind string, verdict string, size long"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of requests as they arrive in a folder."""
    return spark.readStream.schema(REQUEST).json(folder)


def actions(stream: DataFrame, limit: int = 50 << 20, closed: bool = False) -> DataFrame:
    return stream.withColumn("action", action(F.col("kind"), F.col("verdict"), F.col("size"), limit, closed))


def first_scans(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first request of each key inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def windowed(stream: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by action in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select("w.start", "w.end", "action", "n")


def client_sessions(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n")).select("key", "w.start", "w.end", "n")


class VerdictCache(StatefulProcessor):
    """The time of each key's last scan, kept until the watermark passes its time to live."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "since long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """All of a key's rows of a micro-batch in time order, however many parts they come in."""
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = since = self.since.get()[0] if self.since.exists() else None
        cached = []
        for t, verdict in zip((batch["ts"] - pd.Timestamp(0)) // pd.Timedelta("1s"), batch["verdict"], strict=True):
            hit = since is not None and t - since <= self.ttl
            if not hit and verdict != "error":
                since = int(t)
            cached.append(hit)
        if since is not None and since != before:
            self.since.update((since,))
            if before is not None:
                self.handle.deleteTimer((before + self.ttl) * 1000)
            self.handle.registerTimer((since + self.ttl) * 1000)
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "cached": cached})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.since.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "cached": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def cached(stream: DataFrame, ttl: int = 86_400, late: str = "1 hour") -> DataFrame:
    """key, event_id and cached: whether a real verdict of the key is at most ttl seconds old when the request comes.

    Rows later than the watermark go. A key's rows of one micro-batch are held together (bound it by maxFilesPerTrigger);
    across micro-batches one number is kept, in the RocksDB state store, which the session must name (STATE_STORE).
    """
    rows = stream.withWatermark("ts", late).select("key", "event_id", "ts", "verdict")
    return rows.groupBy("key").transformWithStateInPandas(VerdictCache(ttl), "key string, event_id long, cached boolean", "append", "eventTime")


def dashboard(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """scanned, clean, malicious and blocked so far, for update mode: one row that each micro-batch with new requests replaces.

    A request that comes again (same event_id) inside the watermark counts once.
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    action_, verdict = F.col("action"), F.col("verdict")
    counts = {"scanned": action_.isin("forward", "block"), "clean": verdict == "clean", "malicious": verdict == "malicious", "blocked": action_ == "block"}
    return once.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def write_dashboard(counts: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds"):
    """Replaces the one row at path with the newest counts, with the number of their batch; a batch that is run again writes the same row.

    every=None: takes what is there, in as many batches as the source makes of it, and ends.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).coalesce(1).write.mode("overwrite").json(f"{path}/latest")  # one row

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch as Parquet by batch number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
