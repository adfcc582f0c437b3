"""Stages as incremental jobs: only what is new since the last run is read, and the sink is idempotent.

The stages' bookkeeping has no streaming counterpart in a batch of scripts; this is an extension of the pending sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_stage(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame]) -> None:
    """Apply ``stage`` to the files that arrived in ``source`` since the last run and write each batch to its own folder of ``sink``.

    A batch that is run again after a failure overwrites its folder, so every row arrives once.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, kind: str, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, kind, n, total``: events per tumbling window, for a stream or a table; events later than ``late`` are dropped by a stream."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__t", late) if events.isStreaming else timed
    return timed.groupBy(F.window("__t", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), kind, "n", "total"
    )
