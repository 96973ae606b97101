"""Structured Streaming operators over event streams, each with a batch twin of the same result."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from grainsift.sources.files import scratch


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A file stream over a folder of Parquet files; timestamps without zone are read as UTC, which watermarks need.

    Files are read in order of modification time, files_per_trigger at once. A watermark follows what was read, so where
    writers end in any order, lateness must cover the time by which a file can overtake another.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumns({c: F.col(c).cast("timestamp") for c, kind in s.dtypes if kind == "timestamp_ntz"})


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote: exactly-once files, checkpoint in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def replace(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{epoch % 2}")

    q = stream.writeStream.foreachBatch(replace).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{out}/{last % 2}")


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, *, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling or sliding event-time counts and maxima; late rows beyond the watermark are dropped by a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), by, "n", "top")


def session_counts(events: DataFrame, gap: str, *, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions by gap: key, start, events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    """The first event of each key; a stream forgets keys behind its watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def enriched(events: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Stream-static join."""
    return events.join(users, key, "left")


def followed_by(first: DataFrame, second: DataFrame, key: str, within: str, *, late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: (key, first_id, second_id) where second follows first within a time; both have key, ts, id."""
    a = first.select(F.col(key).alias("ka"), F.col("ts").alias("ta"), F.col("id").alias("first_id"))
    b = second.select(F.col(key).alias("kb"), F.col("ts").alias("tb"), F.col("id").alias("second_id"))
    if first.isStreaming:
        a, b = a.withWatermark("ta", late), b.withWatermark("tb", late)
    return a.join(b, F.expr(f"ka = kb AND tb > ta AND tb <= ta + INTERVAL {within}")).select(F.col("ka").alias(key), "first_id", "second_id")


def exact_sum(values: list[float]) -> list[float]:
    """Few doubles with exactly the sum of the values, the first of them that sum rounded once; none for zero."""
    parts: list[float] = []
    while rest := math.fsum([*values, *(-p for p in parts)]):
        parts.append(rest)
        if not math.isfinite(rest):
            break
    return parts


class SpendMeter(StatefulProcessor):
    """R7, R8 as a stateful operator: running spend of each key, reported whenever it passes another multiple of the cap.

    The spend is kept exactly, so its multiples don't hang on the order or the batches in which rows arrive.
    """

    def __init__(self, cap: float):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "parts array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = list(self.spent.get()[0]) if self.spent.exists() else []
        new = old
        for pdf in rows:
            new = exact_sum([*new, *pdf["value"].dropna().tolist()])
        self.spent.update((new,))
        before, times = (math.floor(x[0] / self.cap) if x else 0 for x in (old, new))
        if times > before:
            yield pd.DataFrame({"key": [str(key[0])], "times": [times]})

    def close(self) -> None:
        pass


def spend_alerts(events: DataFrame, key: str, cap: float) -> DataFrame:
    """Alerts (key, times over the cap) of a stream; transformWithState keeps a few numbers per key (RocksDB state store needed)."""
    return events.select(key, "value").groupBy(key).transformWithStateInPandas(SpendMeter(cap), "key string, times long", "Append", "None")


def upsert_into(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest version of each key; alternating folders, so a failed batch can be replayed."""

    def apply(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        rows = df
        if epoch > 0:
            rows = rows.unionByName(spark.read.schema(df.schema).parquet(f"{path}/{(epoch - 1) % 2}"))
        rest = [c for c in df.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
        best.write.mode("overwrite").parquet(f"{path}/{epoch % 2}")

    return apply


def last_before(events: DataFrame, key: str, value: Column) -> DataFrame:
    """As-of lookup of the previous value of each key: the batch form."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("previous", F.last(value, ignorenulls=True).over(w))
