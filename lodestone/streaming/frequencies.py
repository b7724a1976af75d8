"""Document frequencies over a stream: an extension, batches have none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_document_frequency(stream: DataFrame, token: str, document: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, token, freq): in how many documents a token came up in each window of event time.

    Rows up to ``late`` behind the newest are counted. The number of documents is approximate
    (a sketch in the state instead of the documents), exact in practice for small windows.
    """
    timed = stream.withWatermark(time, late)
    per = timed.groupBy(F.window(time, window).alias("w"), F.col(token).alias("token")).agg(F.approx_count_distinct(document, 0.01).alias("freq"))
    return per.select(F.col("w.start").alias("start"), "token", "freq")


def write_increments(counts: DataFrame, path: str, checkpoint: str):
    """Append closed windows to Parquet, and stop when the input is read."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
