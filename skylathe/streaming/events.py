"""The event lift over a stream: each micro-batch of extracted rows meets the static log index and is appended.

An extension: the lift has no state, so nothing needs a watermark; the log index is a static side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.lift import lift_events


def stream_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def lift_stream(rows: DataFrame, logs: DataFrame, kind: str, out: str, checkpoint: str, base: str) -> StreamingQuery:
    """Starts a query that writes the triples of each micro-batch, a set per batch, under ``out``; with the
    checkpoint each batch is written once even if the query restarts."""

    def write(batch: DataFrame, number: int) -> None:
        lift_events(batch, logs, kind, base).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
