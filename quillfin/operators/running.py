"""Running aggregates that stay parallel when one key owns most of the rows.

``sum(x) OVER (PARTITION BY key ORDER BY o)`` sorts a whole key inside one task. That is the cheapest
plan while the largest key is small, which ``key_blocks`` measures. Beyond that every key is cut into
blocks of the order column, blocks are aggregated before the shuffle, only the short list of block
totals is windowed per key, and each row combines its block's carry with a window local to
``(key, block)``. The largest unit of work is then one block, never one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows one key may have and still be ordered inside one task; the Spark setting overrides it.
HOT_ROWS = 1_000_000
HOT_ROWS_SETTING = "spark.quillfin.hotKeyRows"

_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running column. ``before`` leaves the current row out of the frame."""

    out: str
    fn: str
    value: Column
    before: bool = False


def key_blocks(df: DataFrame, keys: Sequence[str], block: Column) -> Column | None:
    """``block`` if some key has more rows than one task should order, else ``None``."""
    limit = int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return block if largest > limit else None


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column | None,
    specs: Sequence[Running],
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order`` (a total order per key).

    ``block`` comes from ``key_blocks``. It must never decrease along ``order`` and bounds how many
    rows share a block; keys and block must not be null. ``None`` is a plain window.
    """
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        out = df
        for s in specs:
            value = _AGGREGATE[s.fn](s.value).over(_rows(whole, s))
            out = out.withColumn(s.out, F.coalesce(value, F.lit(0)) if s.fn in ("sum", "count") else value)
        return out
    blocked = df.withColumn("_blk", block)
    scope = [*keys, "_blk"]
    totals = blocked.groupBy(*scope).agg(
        *[_AGGREGATE[s.fn](s.value).alias(f"_t{i}") for i, s in enumerate(specs)]
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *scope,
        *[_merge_totals(s.fn)(F.col(f"_t{i}")).over(earlier).alias(f"_c{i}") for i, s in enumerate(specs)],
    )
    # First blocks have nothing before them, so only the others need a carry.
    later = carry.where(reduce(or_, [F.col(f"_c{i}").isNotNull() for i in range(len(specs))]))
    inside = Window.partitionBy(*scope).orderBy(*order)
    joined = blocked.join(later, scope, "left")
    for i, s in enumerate(specs):
        local = _AGGREGATE[s.fn](s.value).over(_rows(inside, s))
        joined = joined.withColumn(s.out, _combine(s.fn, local, F.col(f"_c{i}")))
    return joined.drop("_blk", *[f"_c{i}" for i in range(len(specs))])


def _rows(window, spec: Running):
    return window.rowsBetween(Window.unboundedPreceding, -1 if spec.before else 0)


def _merge_totals(fn: str):
    return F.sum if fn in ("sum", "count") else _AGGREGATE[fn]


def _combine(fn: str, local: Column, carry: Column) -> Column:
    if fn == "max":
        return F.greatest(local, carry)
    if fn == "min":
        return F.least(local, carry)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
