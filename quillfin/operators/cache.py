"""Page-image cache as a table ``(sha, page, bytes, mtime)``: addressing, sizes, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.operators.running import Running, key_blocks, running
from quillfin.operators.skew import keyed_filter


def safe_sha(sha: Column) -> Column:
    return F.regexp_replace(sha, "[^0-9A-Za-z]", "")


def page_path(sha: Column, page: Column) -> Column:
    """Relative path of a cached page, sharded by the first two characters of the hash."""
    clean = safe_sha(sha)
    return F.concat_ws("/", F.substring(clean, 1, 2), clean, F.concat(page.cast("string"), F.lit(".webp")))


def cache_size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"), F.count("*").alias("n_entries"))


def evict_files(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries left after dropping every page of the given source files."""
    return keyed_filter(entries, gone, "sha", "page", "left_anti")


def lru_evictions(entries: DataFrame, order: list[str], block: Column, max_bytes: Column | int) -> DataFrame:
    """Mark the entries to delete: oldest first until the rest fits in ``max_bytes``.

    An entry goes while what is left before deleting it is still over the cap. ``order`` is a total
    order starting with the modification time and ``block`` follows it.
    """
    cap = F.lit(max_bytes) if isinstance(max_bytes, int) else max_bytes
    total = entries.agg(F.sum("bytes").alias("_total"))
    summed = running(entries, [], [F.col(c) for c in order], key_blocks(entries, [], block), [Running("older_bytes", "sum", F.col("bytes"), before=True)])
    # The total is one row, so attaching it is a constant, not a join of two tables.
    return (
        summed.join(F.broadcast(total), F.lit(True))
        .withColumn("evict", F.col("_total") - F.col("older_bytes") > cap)
        .drop("_total")
    )
