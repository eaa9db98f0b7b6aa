"""Which files need work: content hashes against the recorded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.operators import listing


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``content_hash_sha256``. Hashed once per ingest, whole content, in the JVM."""
    return files.withColumn("content_hash_sha256", F.sha2(F.col(content), 256))


def staleness(current: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``action`` (new / changed / unchanged) and the recorded ``point_ids``.

    Only the path and the hash decide; size and time are recorded but never compared.
    """
    known = state.select("path", F.col("content_hash_sha256").alias("_old"), "point_ids")
    return (
        current.join(known, "path", "left")
        .withColumn(
            "action",
            F.when(F.col("_old").isNull(), "new")
            .when(F.col("_old") != F.col("content_hash_sha256"), "changed")
            .otherwise("unchanged"),
        )
        .drop("_old")
    )


def ingest_stats(planned: DataFrame) -> DataFrame:
    """Added, updated and unchanged counters in one row.

    A stale file counts as updated only if points were recorded for it.
    """
    had_points = F.size(F.coalesce("point_ids", F.array().cast("array<string>"))) > 0
    stale = F.col("action") != "unchanged"
    return planned.agg(
        F.count_if(stale & ~had_points).alias("files_added"),
        F.count_if(stale & had_points).alias("files_updated"),
        F.count_if(~stale).alias("files_skipped_unchanged"),
    )


def superseded_points(planned: DataFrame, version: int) -> DataFrame:
    """Tombstones for the recorded points of changed files."""
    return planned.where("action = 'changed'").select(
        F.explode("point_ids").alias("segment_id"), F.lit(version).cast("long").alias("version")
    )


def orphaned_files(known: DataFrame, current: DataFrame, roots: list[str]) -> DataFrame:
    """Recorded files under ``roots`` that are gone, with the points they leave behind."""
    below = listing.under(F.col("path"), roots)
    return known.where(below).join(current.select("path"), "path", "left_anti").select("path", "point_ids")
