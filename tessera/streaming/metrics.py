"""Structured Streaming over generated text: an extension, for rows that arrive while generation runs.

Redaction and normalisation are row by row; counts by class and time window close when the
watermark has passed them, so that state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.redact import redacted
from tessera.functions.text import normalised, token_count


def redacted_stream(rows: DataFrame) -> DataFrame:
    """Rows with `text` redacted and normalised; empty ones dropped."""
    return rows.withColumn("text", normalised(redacted(F.col("text")))).where("text <> ''")


def class_counts(rows: DataFrame, time: str = "ts", label: str = "label1", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows and words by class and tumbling window; rows later than `late` are not counted."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, window), label)
        .agg(F.count("*").alias("n"), F.sum(token_count(F.col("text"))).alias("n_words"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), label, "n", "n_words")
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet; with a checkpoint each row is written once, also after a restart."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
