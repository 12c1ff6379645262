"""Streams: high-rate ingest into versioned tables, and windowed counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.session import Engine


def upsert_stream(engine: Engine, stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream into a table with a key: of each key the last row counts. A batch that is delivered
    again after a failure replaces the same rows, so its effect is that of one delivery."""

    def batch(rows: DataFrame, _: int) -> None:
        change = engine.database.write(table, rows, "I", engine.database.latest())
        engine.database.commit([change])
        engine.database.maybe_compact(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Events counted in tumbling windows, or in sliding ones; those later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Events counted in sessions, which end where none of the same `by` follows for `gap`."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
