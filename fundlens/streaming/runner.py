"""Runs a stream over what is there now and returns its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundlens.session import scratch_path


def drain(stream: DataFrame, name: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """Process all available input into a parquet table and read it.

    Append streams use the file sink, which commits each batch once. Complete-mode streams
    rewrite their (small) aggregate table every batch, under the batch number.
    """
    spark = stream.sparkSession
    path = out or scratch_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    writer.foreachBatch(keep).outputMode(mode).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[0]}")


def for_each_batch(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Run ``fn`` on every batch of the available input."""
    place = state or scratch_path(stream.sparkSession, f"{name}-state")
    (
        stream.writeStream.foreachBatch(fn)
        .option("checkpointLocation", place)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, or of a glob pattern, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
