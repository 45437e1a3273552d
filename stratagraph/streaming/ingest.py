"""Profiles from a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profiles import SPEEDSCOPE, bronze_profiles, frame_rows, function_stats, valid
from ..scratch import discard, materialise
from ..store import Store


def stream_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """New speedscope files of a folder, as ``read_speedscope`` has them; a file is taken once within a day."""
    raw = spark.readStream.schema(SPEEDSCOPE).option("multiLine", True).json(folder)
    raw = raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source_file"), F.col("_metadata.file_modification_time").alias("arrived"), "*")
    return raw.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["source_file"]).drop("arrived")


def store_batch(store: Store, raw: DataFrame, repo_path: str | None = None, metadata: dict | None = None) -> int:
    """Put a batch's profiles into a store; the same batch again replaces them. Returns how many."""
    bronze = materialise(bronze_profiles(raw.where(valid(raw)), repo_path, metadata), "bronze")
    n = bronze.count()
    if n:
        store.put_profiles(bronze.drop("frames", "samples", "weights", "events"), frame_rows(bronze), function_stats(bronze))
    discard(bronze)
    return n


def ingest_stream(store: Store, folder: str, checkpoint: str, repo_path: str | None = None, once: bool = True) -> StreamingQuery:
    """Keep a store up to date with a folder; ``once`` ends after what is there."""
    writer = stream_profiles(store.spark, folder).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, _: store_batch(store, batch, repo_path) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
