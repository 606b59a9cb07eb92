"""Resumable extraction as a stream, and windowed aggregates over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annales.sources.files import exists


def extract_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], key: str = "id", dead: str | None = None) -> StreamingQuery:
    """Runs `extract` over chunks that arrive in a folder; keys already in the sink are passed over.

    Each micro-batch is one append, so a restart repeats at most one batch, whose
    rows the sink's keys keep out. Rows of `extract` with a non-null `error` go
    to the dead-letter folder instead.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        if exists(spark, sink):
            rows = rows.join(spark.read.parquet(sink).select(key).distinct(), key, "left_anti")
        out = extract(rows)
        if "error" in out.columns:
            out = out.persist()
            if dead is not None:
                out.where("error IS NOT NULL").write.mode("append").parquet(dead)
            out.where("error IS NULL").drop("error").write.mode("append").parquet(sink)
            out.unpersist()
        else:
            out.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(window_start, kind, n, total) of tumbling or sliding windows; in a stream rows later than `late` are left out.

    An addition of this engine: the replaced one has no event windows.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", user: str = "user_id", late: str = "1 day") -> DataFrame:
    """(user, session_start, n): sessions parted by gaps of silence."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(user, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("session_start"), "n")
