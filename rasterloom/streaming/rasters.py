"""Rasters as a stream: whole images arrive as micro-batches of pixels and pass through any batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def stream_images(pixels: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True):
    """Apply a batch operator to each micro-batch and write its result once per batch id, so a replay overwrites itself.

    An image's pixels must arrive in one file, as files are the unit of a micro-batch.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = pixels.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
