"""Continuous ingest: a stream of file names keeps an index up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillfin.plans.ingest import Models, ingest
from quillfin.settings import Settings
from quillfin.sources.index import Index

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 10_000) -> DataFrame:
    """Paths of new files below a folder (contents are read by the ingest, not carried here)."""
    stream = (
        spark.readStream.format("binaryFile").schema(FILES)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return stream.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def keep_indexed(
    index: Index, paths: DataFrame, models: Models, settings: Settings, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Ingest each micro-batch of paths; a repeated batch finds its files unchanged and adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        # The batch size is bounded by files_per_trigger.
        names = [r["path"] for r in rows.select("path").distinct().toLocalIterator()]
        if names:
            ingest(index, names, models, settings, purge=False)

    writer = paths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
