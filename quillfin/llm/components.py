"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins on node keys; no neighbour list is ever collected, so a
hub's edges can be split over tasks. Each round's edges are a reliable checkpoint. Their number is known
from the first round on, and a round has as many tasks as they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.session import checkpoint_dir, gathered


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; an empty table gives an empty result.
    """
    checkpoint_dir(edges.sparkSession)
    stars = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
        .checkpoint()
    )
    state = _state(stars)
    while True:
        stars = gathered(stars, state[0])
        stars = _small_star(_large_star(stars, state[0]), state[0]).checkpoint()
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("lo").alias("node")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(stars: DataFrame, rows: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return gathered(gathered(linked, rows).distinct(), rows)


def _small_star(stars: DataFrame, rows: int) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = stars.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = stars.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return gathered(gathered(moved.unionAll(least.select("hi", F.col("m").alias("lo"))), rows).distinct(), rows)
