"""Listwise rerankers: a prompt over the candidates of a query in, a JSON reply with ranks out.

A model is any picklable object with ``generate(prompt, images) -> str``. A model that fails leaves
the order as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.models.limits import Expired, within
from quillfin.models.topics import TopicModel
from quillfin.operators import rerank
from quillfin.operators.topics import page_label


def rank_prompt(query: Column, candidates: Column) -> Column:
    def one(c: Column) -> Column:
        return F.concat(
            F.lit("["), c["id"], F.lit("] "), F.coalesce(c["title"], F.lit("")), F.lit(" (pages "), c["pages"], F.lit(")\n"),
            F.coalesce(c["summary"], F.lit("")), F.lit("\n"), c["excerpt"],
        )

    return F.concat(
        F.lit('Rank the candidates for the question. Answer with a JSON array of {"id", "rank", "score", "reason"}.\nQuestion: '),
        query, F.lit("\n---\n"), F.array_join(F.transform(candidates, one), "\n\n"),
    )


def reranked(
    results: DataFrame, queries: DataFrame, model: TopicModel, max_candidates: int, images: DataFrame | None = None, timeout: float | None = None
) -> DataFrame:
    """Results in the model's order with ``rerank_reason``; one model call per query, of ``timeout`` seconds at
    most. Without a reply the order stays.

    ``images`` (``sha, page, image``) are the pages that the model sees: each candidate's hero page, in the
    order of the candidates, where there is one.
    """
    entry = F.struct(
        (F.col("rank") - 1).alias("id"), "title", "summary",
        page_label(F.coalesce("page_refs", F.array().cast("array<int>")), "-", 100).alias("pages"),
        F.substring("excerpt", 1, 400).alias("excerpt"),
    )
    lists = results.where(F.col("rank") <= max_candidates).groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    asked = lists.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", F.transform("c", lambda c: c["id"]).alias("candidates"), rank_prompt(F.col("query"), F.col("c")).alias("prompt")
    )
    if images is None:
        asked = asked.withColumn("images", F.array().cast("array<binary>"))
    else:
        heroes = results.where(F.col("rank") <= max_candidates).select("query_id", "rank", F.col("file_sha256").alias("sha"), F.col("hero_page").alias("page"))
        # At most max_candidates images for each query.
        seen = heroes.join(images, ["sha", "page"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "image"))).alias("i"))
        asked = asked.join(seen, "query_id", "left").select(
            "query_id", "candidates", "prompt",
            F.coalesce(F.transform("i", lambda i: i["image"]), F.array().cast("array<binary>")).alias("images"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for prompt, pictures in zip(batch.column("prompt").to_pylist(), batch.column("images").to_pylist()):
                try:
                    replies.append(within(lambda: model.generate(prompt, pictures), timeout))  # noqa: B023 - called at once
                except (Expired, Exception):  # noqa: BLE001 - no reply, no change of order
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("candidates"), pa.array(replies, pa.string())], names=["query_id", "candidates", "reply"])

    replies = asked.mapInArrow(run, "query_id string, candidates array<int>, reply string")
    return rerank.merge_ranks(results, rerank.parse_ranks(replies), max_candidates)
