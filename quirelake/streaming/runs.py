"""Event logs as streams: cursor reads, windows, sessions and the run state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators import ordering

TERMINAL = ("done", "error_msg")


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of event files; the checkpoint's offset is the cursor, so every event is read once. path: a file or a
    folder of files."""
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # a pattern may be a file, a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(either).withColumn("ts", F.col("ts").cast("timestamp"))


def after(log: DataFrame, cursor: int) -> DataFrame:
    """Events behind a cursor, without empty log messages."""
    return log.where(F.col("event_id") > cursor)


def windowed(log: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and kind; later rows than the watermark are dropped by streams, not by batches."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(log: DataFrame, idle: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after an idle time."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count("*").alias("n"))


def run_states(log: DataFrame) -> DataFrame:
    """A state machine per user: done, failed and retried pages, and the run's phase, kept across batches. A failed
    page that later succeeds leaves the failures; counters never fall below zero."""
    STATE = "done int, failed int, phase string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failed, phase = state.get if state.exists else (0, 0, "idle")
        for b in batches:
            for kind in b.sort_values("event_id")["event_type"]:
                if kind == "purchase":
                    done, failed, phase = done + 1, max(0, failed - 1), "running"
                elif kind in ("error", "refund", "logout"):
                    failed, phase = failed + 1, "partial_failed"
                else:
                    phase = "running" if phase == "idle" else phase
        state.update((done, failed, phase))
        yield pd.DataFrame({"user_id": [key[0]], "done": [done], "failed": [failed], "phase": [phase]})

    return log.groupBy("user_id").applyInPandasWithState(step, "user_id long, done int, failed int, phase string", STATE, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give the result as a table in memory; for small results."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def appended(stream: DataFrame, path: str, checkpoint: str):
    """A stream into a log of Parquet files, exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upserting(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]):
    """Each micro-batch laid over a table of the newest row per key. A batch writes a new version under its own number
    and reads the one before, so a repeated batch gives the same table."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        own = ordering.latest(df, key, order)
        if n:
            own = ordering.latest(spark.read.schema(df.schema).parquet(f"{path}/version={n - 1}").unionByName(own), key, order)
        own.write.mode("overwrite").parquet(f"{path}/version={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
