"""Deletion vectors: which rows of which data file are dead, as bits by position.

A scan knows the file and the position of each of its rows, so a dead row is dropped by a look at its
file's bits. Ids are resolved to positions once, when they are deleted; from then on no scan joins on ids
and no wide column is shuffled to find out what lives.

The bits of 32,768 consecutive rows are one container, which holds the 64-bit words that are not zero: ten
bytes for a lonely row, five kilobytes for a dead block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 15
WORD = 64
# Containers that one scan has broadcast at most; more are dealt to several scans of different files.
BROADCAST_BYTES = 64 << 20
DELETIONS = "file string, block bigint, at array<smallint>, bits array<bigint>"


def with_positions(scan: DataFrame) -> DataFrame:
    """A file scan with ``_file``, folder and name of the data file, and ``_row``, the place in it."""
    return scan.select("*", F.substring_index("_metadata.file_path", "/", -2).alias("_file"), F.col("_metadata.row_index").alias("_row"))


def dead_positions(scan: DataFrame, deleted: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """``_file, _row`` of the rows of a ``with_positions`` scan whose ``key`` is in ``deleted``; with ``version``, of those
    whose version is lower than one of the key's. Only keys and positions are read and joined."""
    if version is None:
        return scan.select(key, "_file", "_row").join(deleted.select(key).distinct(), key, "left_semi").select("_file", "_row")
    gone = deleted.groupBy(F.col(key).alias("_k")).agg(F.max(version).alias("_gone_at"))
    held = scan.select(key, version, "_file", "_row")
    return held.join(gone, (F.col(key) == F.col("_k")) & (F.col("_gone_at") > F.col(version)), "left_semi").select("_file", "_row")


def containers(dead: DataFrame) -> DataFrame:
    """``DELETIONS`` for ``_file, _row``; positions may repeat. Bits are combined before and after the shuffle."""
    placed = dead.select(
        F.col("_file").alias("file"),
        F.floor(F.col("_row") / BLOCK_ROWS).cast("long").alias("block"),
        F.floor((F.col("_row") % BLOCK_ROWS) / WORD).cast("smallint").alias("word"),
        F.expr(f"shiftleft(1L, cast(_row % {WORD} as int))").alias("bit"),
    )
    return _gathered(placed.groupBy("file", "block", "word").agg(F.bit_or("bit").alias("bits")))


def merged(deletions: DataFrame) -> DataFrame:
    """One container for each file and block, from those of several versions."""
    words = deletions.select("file", "block", F.explode(F.arrays_zip("at", "bits")).alias("w"))
    return _gathered(words.groupBy("file", "block", F.col("w.at").alias("word")).agg(F.bit_or("w.bits").alias("bits")))


def _gathered(words: DataFrame) -> DataFrame:
    # At most BLOCK_ROWS / WORD words.
    sorted_words = F.sort_array(F.collect_list(F.struct("word", "bits")))
    found = words.groupBy("file", "block").agg(sorted_words.alias("w"))
    return found.select("file", "block", F.col("w.word").alias("at"), F.col("w.bits").alias("bits"))


def _is_dead() -> Column:
    word = F.floor((F.col("_row") % BLOCK_ROWS) / WORD).cast("smallint")
    nth = F.array_position("_at", word).cast("int")
    bits = F.when(nth > 0, F.element_at("_bits", nth))
    # No container and no word are null, and so not dead.
    return F.coalesce(F.getbit(bits, (F.col("_row") % WORD).cast("int")) == 1, F.lit(False))


def live(scan: DataFrame, deletions: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of a ``with_positions`` scan that no container of ``deletions`` names; positions are left out.

    Containers travel to the rows. Their measured size decides how many scans share the files: each reads
    its own files and gets the containers of those, at most about ``broadcast_bytes``.
    """
    one = merged(deletions).checkpoint()
    size = one.agg(F.sum(F.size("at") * 10 + F.octet_length("file") + 100).alias("b")).first()["b"]
    if not size:
        return scan.drop("_file", "_row")
    groups = 1 + size // broadcast_bytes
    parts = []
    for g in range(groups):
        mine = lambda file: F.pmod(F.xxhash64(file), F.lit(groups)) == g
        few, rows = (one, scan) if groups == 1 else (one.where(mine("file")), scan.where(mine("_file")))
        given = F.broadcast(few.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("at").alias("_at"), F.col("bits").alias("_bits")))
        placed = rows.withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS).cast("long"))
        parts.append(placed.join(given, ["_file", "_block"], "left").where(~_is_dead()).select([c for c in scan.columns if c not in ("_file", "_row")]))
    return reduce(DataFrame.unionAll, parts)
