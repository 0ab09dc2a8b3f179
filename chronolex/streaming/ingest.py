"""Incremental ingest: new raw documents run through the batch transformations, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed_table import KeyedTable


def append_new(table: KeyedTable, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds the rows whose keys the table lacks. It reads only the buckets of a batch's keys, and commits
    the batch's number with its rows: a batch that has been written does nothing when it is run again, one that failed midway has
    left nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        table.insert_ignore(batch, order, label=f"batch-{number}")

    return sink


def ingest_stream(spark: SparkSession, folder: str, transform: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str, files_at_a_time: int = 1000) -> StreamingQuery:
    """Every file that appears in the folder becomes (key, raw_uri, xml), is transformed and added to the table; ends when all are
    read. The checkpoint belongs to the table: batches are numbered by it."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_a_time)
    files = reader.load(folder).select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("raw_uri"))
    documents = files.withColumn("key", F.regexp_extract("raw_uri", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return transform(documents).writeStream.foreachBatch(append_new(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
