"""Bounded samples of labelled rows, the only rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that a classifier learns from, at most.
SAMPLE_ROWS = 8_000


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``label`` (0 or 1), ``fold`` (0 or 1) and the columns of ``docs`` for up to ``rows`` labelled rows,
    those that come first by a hash of ``doc_id``; the same rows on each run.

    Ids are chosen among the labels first, so only the chosen documents are read out, by a broadcast of
    at most ``rows`` ids. Null labels and ids are left out; an id with several labels has the largest.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(allowed) if allowed is not None else usable
    by_hash = F.xxhash64("doc_id")
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
        .orderBy(by_hash, "doc_id")
        .limit(rows)
        .select(F.col("doc_id"), F.col("label"), F.pmod(by_hash, F.lit(2)).cast("int").alias("fold"))
    )
    clashing = [c for c in ("label", "fold") if c in docs.columns]
    return docs.drop(*clashing).join(F.broadcast(chosen), "doc_id")
