"""Segments traces as they arrive: an engine on every micro-batch, stored once per trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.sources import store

TRACES = "id string, rt string, stored_at timestamp"


def resume(spark: SparkSession, arriving: str, path: str, exp_id: str, engine: Callable[[DataFrame], DataFrame], checkpoint: str, schema: str = TRACES) -> StreamingQuery:
    """A streaming query over parquet files in a folder; ends when all that is there has been segmented.

    A batch that is run again after a failure adds nothing, since traces with a
    stored result are left out.
    """
    traces = spark.readStream.schema(schema).parquet(arriving)

    def batch(rows: DataFrame, _: int) -> None:
        store.segment(rows.sparkSession, path, rows, exp_id, engine)

    return traces.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, arriving: str, schema: str = TRACES, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Traces per window of the time they were stored, with a watermark for late ones."""
    traces = spark.readStream.schema(schema).parquet(arriving)
    return traces.withWatermark("stored_at", delay).groupBy(F.window("stored_at", width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("since"), "n")
