"""Listwise reranking: merge a model's ranks into the result order, and parse its replies.

``results`` rows: ``query_id, rank, ...`` in score order. ``ranks`` rows: ``query_id, id, rank,
score, reason`` with ``id`` the zero-based candidate position; ``ord`` keeps the reply's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.functions import jsonx
from quillfin.functions.text import unfenced

UNRANKED = 999

def merge_ranks(results: DataFrame, ranks: DataFrame, max_candidates: int = 10) -> DataFrame:
    """Results with new ``rank`` and ``rerank_reason``.

    Only the first ``max_candidates`` of a query may move: placed ones first by (rank, score), a rank
    of 0 counting as missing, then unplaced candidates, then the tail, both in their old order. Of
    several ranks for one candidate the best-sorting wins. Without ranks the order stays.
    """
    sort_rank = F.when(F.coalesce(F.col("rank"), F.lit(0)) == 0, UNRANKED).otherwise(F.col("rank"))
    order = F.struct(sort_rank.alias("r"), (-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("ord").alias("o"))
    placed = (
        ranks.where((F.col("id") >= 0) & (F.col("id") < max_candidates))
        .groupBy("query_id", F.col("id").alias("_id"))
        .agg(F.min_by(F.struct("reason", order.alias("sort")), order).alias("_r"))
    )
    joined = results.withColumn("_id", F.col("rank") - 1).join(placed, ["query_id", "_id"], "left")
    fresh = Window.partitionBy("query_id").orderBy(F.col("_r").isNull(), F.col("_r.sort"), "_id")
    kept = [F.col(c) for c in results.columns if c not in ("query_id", "rank")]
    return joined.select(
        "query_id",
        F.row_number().over(fresh).alias("rank"),
        *kept,
        F.nullif(F.col("_r.reason"), F.lit("")).alias("rerank_reason"),
    )


def reply_entries(replies: DataFrame) -> DataFrame:
    """One row per rank object of a reply, ``query_id, candidates, ord, e``: the items of the array if the
    reply's outermost brackets hold one, otherwise every complete flat ``{...}`` on its own."""
    # Steps are separate projections so that no regular expression runs twice.
    body = replies.select("query_id", "candidates", unfenced(F.col("reply")).alias("body"))
    listed = body.withColumn("whole", jsonx.strict(F.nullif(F.regexp_extract("body", r"(?s)\[.*\]", 0), F.lit(""))))
    single = F.transform(F.regexp_extract_all("body", F.lit(r"(\{[^{}]*\})"), F.lit(1)), jsonx.strict)
    entries = F.when(jsonx.kind(F.col("whole")) == "ARRAY", jsonx.items(F.col("whole"))).otherwise(single)
    return listed.select("query_id", "candidates", F.posexplode(F.filter(entries, jsonx.is_object)).alias("ord", "e"))


def parse_ranks(replies: DataFrame) -> DataFrame:
    """Validated ranks: ``query_id, ord, id, rank, score, reason``.

    ``replies``: ``query_id, reply`` and ``candidates``, the ids that count. Each entry is judged by
    itself: its id must be an integer among the candidates; a rank or score that is no number is 0;
    reasons are cut at 200 characters.
    """
    e = F.col("e")
    typed = reply_entries(replies).select(
        "query_id",
        "candidates",
        "ord",
        jsonx.whole_number(jsonx.member(e, "id")).alias("id"),
        F.coalesce(jsonx.whole_number(jsonx.member(e, "rank")), F.lit(0)).alias("rank"),
        F.coalesce(jsonx.number(jsonx.member(e, "score")), F.lit(0.0)).alias("score"),
        F.substring(jsonx.label(jsonx.member(e, "reason")), 1, 200).alias("reason"),
    )
    return typed.where(F.array_contains("candidates", F.col("id"))).drop("candidates")
