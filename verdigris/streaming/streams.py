"""Structured Streaming forms: the same transformations on a stream, and the operators whose state outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scoring, state


def source(spark: SparkSession, folder: str, schema: str, most_files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def scored(messages: DataFrame) -> DataFrame:
    """Messages scored on arrival, by the function that scores tables."""
    return scoring.analyzed(messages).select("msg_id", "risk_score", "verdict", "scam_type")


def counters(reports: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Report counters as an update-mode aggregation."""
    return state.counters(reports, keys, at)


def windows(events: DataFrame, key: str, at: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums; what is later than the watermark is dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, key: str, at: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], at: str = "ts", late: str = "24 hours") -> DataFrame:
    """Each key once within the time to live: a cache that forgets."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def rate_limited(hits: DataFrame, key: str, limit: int, seconds: int = 60, at: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, ts, allowed, retry_after): a moving window for each key, in which denied requests don't count.

    State is the times of the allowed requests of the window, ``limit`` at most, and goes when the watermark has passed the window.
    """

    def run(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        times = list(held.get[0]) if held.exists else []
        out = []
        arrived = pd.concat(parts).sort_values(at)
        for t in arrived[at]:
            now = t.timestamp()
            times = [x for x in times if x > now - seconds]
            allowed = len(times) < limit
            out.append((name[0], t, allowed, 0.0 if allowed else max(0.0, times[0] + seconds - now)))
            if allowed:
                times.append(now)
        held.update((times,))
        held.setTimeoutTimestamp(max(int((now + seconds) * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, "allowed", "retry_after"])

    kind = hits.schema[key].dataType.simpleString()
    return hits.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} timestamp, allowed boolean, retry_after double", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def upserted(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Counters merged into a table for each batch; a batch that is run again writes the same version, so counts stay exact.

    Versions are folders named by batch; the last but one stays until the next batch has been written.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            batch = state.merged_counters(old, batch, keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    def each(batch: DataFrame, number: int) -> None:
        write(state.counters(batch, keys, "ts"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
