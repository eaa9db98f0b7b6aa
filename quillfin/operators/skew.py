"""Semi and anti joins whose key may be shared by any share of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
SALTS = 32


def keyed_filter(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "left_semi", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows of ``left`` whose string ``key`` is (``left_semi``) or is not (``left_anti``) in ``right``.

    The keys are broadcast if their measured size allows, so ``left`` is not shuffled. Otherwise they
    are repeated per salt, and the rows of one key go to ``SALTS`` tasks chosen by ``spread_by``.
    """
    keys = right.select(key).where(F.col(key).isNotNull()).distinct()
    size = keys.agg(F.sum(F.octet_length(key) + 32).alias("b")).first()["b"] or 0
    if size <= broadcast_bytes:
        return left.join(F.broadcast(keys), key, how).select(*left.columns)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return placed.join(salted, [key, "_salt"], how).select(*left.columns)
