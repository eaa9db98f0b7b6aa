"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Per source the document rates ``w`` minimise ``sum(w ln w - w + 1)`` (stay as close to one copy each as
possible) under the token constraint ``sum(w * size) = target`` and ``w <= cap``. The solution is an
exponential tilt, ``w = min(cap, exp(lam * size))``, and ``lam`` is the root of the convex dual's slope,
found for all sources at once by distributed Newton steps kept inside a shrinking bracket.

All steps work on counts per (source, size): the table shrinks before the first shuffle, and one source
with a third of the rows is as many rows as it has different sizes. Rates are rounded into copies by
systematic rounding along the sizes of a source, so the words taken miss the target by about the size of
one document. The extra copies of a (source, size) group are dealt to hash blocks of its rows, so a group
of equal rows is spread over tasks, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.session import checkpoint_dir

WEIGHTS = (5, 2, 1)
CAP = 3.0
TOLERANCE = 1e-7
MAX_STEPS = 80
ROWS_PER_BLOCK = 20_000


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)`` rows, one for each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. No
    target exceeds ``cap`` times its source's size; the excess is shared again, which ends where
    ``target = min(cap * source_size, level * weight)``. One row per source is sorted in one task.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(whole) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    limited = weighed.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("total", total)
    # In the order in which a rising level reaches the sources' limits.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = limited.withColumn("level", (F.col("total") - before) / rest)
    free = F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))
    # Behind the first free source the running level only falls.
    level = F.max(free).over(Window.partitionBy())
    return levelled.withColumn(
        "target", F.coalesce(F.least(F.col("most"), level * F.col("weight")), F.col("most"))
    ).select("source", "source_size", "target")


def _rate(lam: Column, x: Column, cap: float) -> Column:
    """``min(cap, exp(lam * x))`` without overflow."""
    return F.least(F.lit(cap), F.exp(F.least(lam * x, F.lit(50.0))))


def tilts(histogram: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """``(skey, lam, scale)`` for each source: the root of its dual's slope.

    ``histogram`` has ``(skey, size, n)``, ``goals`` ``(skey, source_size, n_rows, target)``. A source
    whose target is ``cap`` times its size, or zero, has no finite root and gets the bracket's end.
    """
    state = goals.select(
        "skey",
        F.col("target"),
        F.greatest(F.col("source_size") / F.col("n_rows"), F.lit(1e-9)).alias("scale"),
        F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.lit(False).alias("done"),
    ).checkpoint()
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), x, cap)
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, tokens * x).otherwise(0.0)
        sums = (
            histogram.join(state.where(~F.col("done")), "skey")
            .groupBy("skey")
            .agg(F.sum(tokens).alias("taken"), F.sum(slope).alias("slope"))
        )
        state = _stepped(state, sums).checkpoint()
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("skey", "lam", "scale")


def _stepped(state: DataFrame, sums: DataFrame) -> DataFrame:
    """One Newton step for each source that is not done; outside its bracket, the middle or the double."""
    miss = F.col("target") - F.col("taken")
    done = F.col("done") | F.col("taken").isNull() | (F.abs(miss) <= F.lit(TOLERANCE) * F.greatest("target", F.lit(1.0)))
    lo = F.when(miss > 0, F.col("lam")).otherwise(F.col("lo"))
    hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("hi"))
    bracketed = state.join(sums, "skey", "left").select("*", done.alias("now"), lo.alias("lo_"), hi.alias("hi_"))
    newton = F.col("lam") + F.try_divide(miss, F.col("slope"))
    inside = (
        newton.isNotNull()
        & (F.col("lo_").isNull() | (newton > F.col("lo_")))
        & (F.col("hi_").isNull() | (newton < F.col("hi_")))
        & (F.abs(newton) <= 2 * F.abs(F.col("lam")) + 4)
    )
    middle = (F.col("lo_") + F.col("hi_")) / 2
    doubled = F.when(miss > 0, F.greatest(2 * F.col("lam"), F.lit(1.0))).otherwise(F.least(2 * F.col("lam"), F.lit(-1.0)))
    # Tilts this steep move nothing more: every document of a word is at its limit.
    steep = F.abs(F.col("lam")) > 1e7
    moved = F.when(F.col("now") | steep, F.col("lam")).when(inside, newton).otherwise(F.coalesce(middle, doubled))
    return bracketed.select(
        "skey", "target", "scale", moved.alias("lam"), F.col("lo_").alias("lo"), F.col("hi_").alias("hi"),
        (F.col("now") | steep).alias("done"),
    )


def mixed(
    docs: DataFrame,
    size_col: str = "size",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    cap: float = CAP,
) -> DataFrame:
    """All columns of ``docs`` plus ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``size_col`` holds each row's words (not null, not negative). ``copies`` is 0 to ``cap``, ``taken`` is
    ``copies * size``. Rows of no words have rate one. A null source is a source of its own, the last.
    Repeated rows are separate rows. Columns of ``docs`` with the names of the new ones are replaced.
    """
    checkpoint_dir(docs.sparkSession)
    new = ["source_size", "target", "rate", "copies", "taken"]
    rest = [c for c in docs.columns if c not in new]
    spread = F.xxhash64(F.col(id_col).cast("string"))
    counted = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("_skey"),
        F.col(size_col).cast("long").alias("_size"),
        spread.alias("_spread"),
    )
    histogram = counted.groupBy(F.col("_skey").alias("skey"), F.col("_size").alias("size")).agg(F.count("*").alias("n")).checkpoint()
    sources = histogram.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_rows"))
    named = sources.withColumn("source", F.when(F.col("skey") != "null", F.expr("substring(skey, 2)")))
    reached = targets(named.select("source", "source_size"), weights, cap).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("skey"), "target"
    )
    goals = sources.join(reached, "skey").checkpoint()
    n_rows = goals.agg(F.sum("n_rows")).first()[0] or 0
    blocks = 1 + n_rows // ROWS_PER_BLOCK
    tilted = tilts(histogram.select("skey", "size", "n"), goals, cap)
    rated = (
        histogram.join(tilted, "skey")
        .join(goals.select("skey", "source_size", "target"), "skey")
        .withColumn("rate", F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(cap)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("scale"), cap)))
        .withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.col("rate")))
    )
    # Systematic rounding: the running sum of fractions, along the sizes of a source, is cut at halves.
    along = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    fraction = F.col("n") * (F.col("rate") - F.floor("rate"))
    running = F.sum(fraction).over(along)
    extra = F.floor(running + 0.5) - F.floor(running - fraction + 0.5)
    quota = rated.select("skey", "size", "source_size", "target", "rate", F.least(F.greatest(extra, F.lit(0)), F.col("n")).alias("extra"))
    block = F.pmod("_spread", F.lit(blocks)).cast("int")
    filled = counted.groupBy(F.col("_skey").alias("skey"), F.col("_size").alias("size"), block.alias("block")).agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("skey", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        filled.withColumn("passed", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        .join(quota, ["skey", "size"])
        .select(
            F.col("skey").alias("_skey"), F.col("size").alias("_size"), F.col("block").alias("_block"), "source_size", "target", "rate",
            F.least(F.greatest(F.col("extra") - F.col("passed"), F.lit(0)), F.col("m")).alias("_extra"),
        )
    )
    placed = docs.select(
        *rest,
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("_skey"),
        F.col(size_col).cast("long").alias("_size"),
        spread.alias("_spread"),
    ).withColumn("_block", block)
    keys = ["_skey", "_size", "_block"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_spread", id_col))
    joined = placed.join(shares, keys).withColumn("_nth", nth)
    copies = (F.floor("rate") + F.when(F.col("_nth") <= F.col("_extra"), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).select(
        *rest, "source_size", "target", "rate", "copies", (F.col("copies") * F.col("_size")).alias("taken")
    )
