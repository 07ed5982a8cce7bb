"""Structured Streaming forms of the progress log and the admission limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docspan.sources.place import new_folder

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream, with an event time that can carry a watermark."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _to_table(result: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return every version of its rows with the batch that wrote it."""
    spark = result.sparkSession
    place = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure overwrites its own folder
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/out/{number:09d}")

    stream = result.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{place}/out")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n, finished: counts by day with a watermark; the last version of each row counts."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    rows = _to_table(w.select(F.col("w.start").alias("day"), "event_type", "n", "last_id"), "update")
    last = rows.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "last_id"), "batch").alias("r"))
    return last.select(F.to_date("day").alias("day"), "event_type", "r.n", "r.last_id")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """user_id, start, n of the sessions that the watermark has closed."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return _to_table(s.select("user_id", F.col("w.start").alias("start"), "n"), "append").drop("batch")


def admission(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, allowed: sequential admission with the admitted times of one window as state.

    Idle keys are forgotten by an event-time timeout once their window has passed the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        open_ = list(state.get[0]) if state.exists else []
        allowed = []
        for t in rows["t"]:
            open_ = [x for x in open_ if x > t - seconds * 1_000_000]
            allowed.append(len(open_) < limit)
            if allowed[-1]:
                open_.append(int(t))
        state.update((open_,))
        state.setTimeoutTimestamp(max(int(rows["t"].max()) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": allowed})

    rows = events.withWatermark("ts", "1 day").select("user_id", "event_id", "ts", F.unix_micros("ts").alias("t"))
    out = rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, allowed boolean", "calls array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return _to_table(out, "append").drop("batch")


def progress_log(events: DataFrame) -> DataFrame:
    """event_id, user_id, event_type, terminal of every event that the stream has seen, appended as it comes."""
    rows = events.select("event_id", "user_id", "event_type", (F.col("event_type") == "error").alias("terminal"))
    return _to_table(rows, "append").drop("batch")
