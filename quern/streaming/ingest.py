"""Micro-batched live ingest of a landing folder of JSONL events, and windowed activity of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.ingest import ingest
from quern.store import Store

SCHEMA = "batch_id string, seq bigint, kind string, payload string"


def stream_ingest(spark: SparkSession, landing: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest every new file of ``landing`` (JSON lines of SCHEMA). Replays are harmless: the store refuses stored keys."""

    def write(batch: DataFrame, _: int) -> None:
        ingest(store, batch).write.format("noop").mode("overwrite").save()

    stream = spark.readStream.schema(SCHEMA).json(landing).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()


def windowed_activity(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour", group: str = "event_type") -> DataFrame:
    """Counts and sums per time window and group; rows later than the watermark are dropped on a stream."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
