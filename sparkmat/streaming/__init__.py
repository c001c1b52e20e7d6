"""Sums of a growing matrix: entries arrive as a stream (cell, gene, value[, time]) and totals are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_sums(entries: DataFrame, axis: str = "cell") -> DataFrame:
    """(axis, total, nnz) so far, as a streaming aggregate; write it in complete or update mode."""
    return entries.groupBy(axis).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz"))


def windowed_sums(entries: DataFrame, time: str, length: str, late: str, axis: str = "gene") -> DataFrame:
    """(start, axis, total, nnz) by windows of ``time``; entries later than ``late`` behind the newest are left out."""
    w = F.window(time, length)
    return entries.withWatermark(time, late).groupBy(w, axis).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz")).select(F.col("window.start").alias("start"), axis, "total", "nnz")


def keep_sums(entries: DataFrame, path: str, checkpoint: str, axis: str = "cell") -> StreamingQuery:
    """Write each batch's own sums under ``path``, a folder a batch, so a repeated batch replaces itself; ``read_sums`` adds them up."""

    def write(batch: DataFrame, number: int) -> None:
        running_sums(batch, axis).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sums(spark, path: str, axis: str = "cell") -> DataFrame:
    """(axis, total, nnz) over all batches written so far."""
    return spark.read.parquet(path).groupBy(axis).agg(F.sum("total").alias("total"), F.sum("nnz").alias("nnz"))
