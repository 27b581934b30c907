"""File-drop ingestion: batch operators over micro-batches of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions.text import clean
from palmleaf.functions.udfs import nfc
from palmleaf.sources.readers import stem


def texts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (path, stem, text): one row a text file that lands."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("stem", stem(F.col("path")))


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """A stream of landed image files with their bytes."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def cleaned(stream: DataFrame) -> DataFrame:
    """The text clean-up on a stream or a table alike."""
    return stream.withColumn("cleaned", clean(nfc(F.col("text"))))


def event_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, with late rows dropped after ``lateness``."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def run(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Applies a batch pipeline to each micro-batch and appends Parquet, a folder a
    batch, so a batch that is tried again replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        batch(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
