"""Structured Streaming over event files: windows with watermarks, keyed state, limits and batch-wise sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, those that come later too."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def tumbling(events: DataFrame, at: str, width: str, late: str, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Figures for each window and key; events later than ``late`` are left out."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *measures)


def sliding(events: DataFrame, at: str, width: str, step: str, late: str, by: list[str], measures: dict[str, Column]) -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width, step), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *measures)


def user_sessions(events: DataFrame, at: str, gap: str, late: str, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Figures for each session: events of a key with less than ``gap`` between them."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *measures)


def distinct_events(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def limited(events: DataFrame, by: str, at: str, key: str, limit: int, window_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events with accepted: a caller's window opens with its first event and takes ``limit``; the next event after its end
    opens another. State is window begin and count, dropped when the watermark is past the window's end; events later
    than ``late`` are left out."""
    out = f"{by} long, {key} long, {at} timestamp, accepted boolean"

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([at, key])
        accepted = []
        for when in rows[at]:
            second = when.timestamp()
            if opened is None or second - opened >= window_seconds:
                opened, used = second, 0
            used += 1
            accepted.append(used <= limit)
        state.update((opened, used))
        state.setTimeoutTimestamp(max(int(1000 * (opened + window_seconds)), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({by: who[0], key: rows[key].to_numpy(), at: rows[at].to_numpy(), "accepted": accepted})

    # a timeout in processing time would keep a run over what is available from ever ending
    return events.withWatermark(at, late).groupBy(by).applyInPandasWithState(step, out, "opened double, used long", "append", GroupStateTimeout.EventTimeTimeout)


def last_values(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Last value of each key so far, for complete or update output."""
    return events.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feed all there is, batch by batch, to ``sink`` and stop; a restart goes on after the last whole batch."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def into_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_parquet(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest batch of each key: every batch goes to a folder of its own, which makes a repeat harmless."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What :func:`upsert_parquet` holds: for each key the rows of its last batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*keys, "batch_id"]).drop("batch_id")
