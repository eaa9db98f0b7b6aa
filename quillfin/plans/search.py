"""Search over an index: bring it up to date, score the live points, shape the answers.

Any number of queries is answered by one scan of the points.
"""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillfin.functions.text import dirname
from quillfin.models.embed import embed
from quillfin.models.rerank import reranked
from quillfin.models.topics import TopicModel
from quillfin.operators import listing, maxsim, points
from quillfin.plans import present
from quillfin.plans.ingest import Ingested, Models, ingest, nothing_ingested
from quillfin.session import checkpoint_dir
from quillfin.settings import Settings
from quillfin.sources.files import directory_entries
from quillfin.sources.index import Index

# Winners of about 200 bytes that are broadcast at most.
BROADCAST_HITS = 100_000

STEPS = ("indexing", "query_embedding", "retrieval", "formatting", "rerank", "total")
FORMATS = ("json", "compact-json", "markdown", "markdown-rich")


@dataclass
class Answer:
    queries: DataFrame  # query_id, query
    results: DataFrame  # at most top_k rows per query
    ingested: Ingested
    status: str
    errors: list[str]
    timing_ms: dict[str, float] = field(default_factory=dict)

    def render(self, form: str = "json") -> DataFrame:
        """``query_id, response`` in one of ``FORMATS``.

        The answer to a single query lists the skipped files; those to several only count them, as the list
        is the same for all (``ingested.skipped``).
        """
        spark = self.queries.sparkSession
        alone = len(self.queries.take(2)) < 2
        listed = F.sort_array(F.collect_list(F.struct("path", "reason"))) if alone else F.array().cast("array<struct<path:string,reason:string>>")
        skipped = self.ingested.skipped.agg(F.count("*").alias("skipped_count"), listed.alias("skipped"))
        errors = spark.createDataFrame([(self.errors,)], "errors array<string>")
        timing = F.struct(*[F.lit(round(self.timing_ms.get(step, 0.0), 1)).alias(f"{step}_ms") for step in STEPS])
        # One-row tables: constants of the answer.
        requests = (
            self.queries.join(F.broadcast(self.ingested.stats), F.lit(True))
            .join(F.broadcast(skipped), F.lit(True))
            .join(F.broadcast(errors), F.lit(True))
            .withColumns({"status": F.lit(self.status), "total_ms": F.lit(round(self.timing_ms["total"], 1)), "timing_ms": timing})
        )
        rows = present.compact(self.results) if form == "compact-json" else self.results
        shaped = present.responses(requests, rows)
        if form in ("json", "compact-json"):
            return present.as_json(shaped)
        return present.as_markdown(shaped) if form == "markdown" else present.as_rich_markdown(shaped)


def _reason(exc: Exception) -> str:
    """What a worker's Python code raised, if that is in the message; else how the message begins."""
    raised = re.findall(r"^\w*(?:Error|Exception): .*$", str(exc), re.MULTILINE)
    return raised[-1] if raised else str(exc)


def search(
    index: Index,
    queries: DataFrame,
    paths: list[str],
    models: Models,
    settings: Settings,
    top_k: int | None = None,
    reranker: TopicModel | None = None,
    cut_first: bool = False,
    image_mode: str | None = None,
) -> Answer:
    """Answer ``queries`` (``query_id, query``) over the files under ``paths``.

    ``cut_first`` takes the best ``top_k`` points before deduplicating by chunk, which may return
    fewer than ``top_k`` chunks; the default deduplicates first.
    """
    paths = [os.path.realpath(p) for p in paths]
    k = top_k or settings.top_k
    wanted = k * settings.rerank_oversample if reranker else k
    clock = time.time()
    timing: dict[str, float] = {}
    errors: list[str] = []
    try:
        done = ingest(index, paths, models, settings)
    except Exception as exc:  # noqa: BLE001 - what is indexed can still be searched
        errors.append(f"Indexing error: {_reason(exc)}")
        done = nothing_ingested(index, paths)
    timing["indexing"] = (time.time() - clock) * 1000
    counted = Observation()
    # Ingest purged what is gone, so the roots say which points count and nothing is joined; only
    # links that lead out of the roots need the list of files.
    below = listing.under(F.col("path"), paths)
    inside = done.files.where(~below).isEmpty()
    corpus = index.points().where(below) if inside else points.in_paths(index.points(), done.files)
    checkpoint_dir(index.spark)
    none = "query_id string, rank int, segment_id string, score double"
    began = time.time()

    def lap(step: str) -> None:
        nonlocal began
        timing[step] = timing.get(step, 0.0) + (time.time() - began) * 1000
        began = time.time()

    few = True
    try:
        vectors = embed(queries.select("query_id", "query"), "query", models.embedder, as_query=True).checkpoint()
        lap("query_embedding")
        # The hits are counted while they are made.
        best = maxsim.maxsim_topk(corpus, vectors, wanted, group=None if cut_first else "chunk_id")
        hits = best.observe(counted, F.count("*").alias("n")).checkpoint()
        few = counted.get["n"] <= BROADCAST_HITS
    except Exception as exc:  # noqa: BLE001 - a failing embedder or scan is an error of the answer
        step = "Retrieval" if "query_embedding" in timing else "Query embedding"
        errors.append(f"{step} error: {_reason(exc)}")
        hits = queries.sparkSession.createDataFrame([], none)
    # Payload is read for the winners only; few winners travel to it, many are joined by key.
    payload = corpus.drop("vectors", "version")
    rows = payload.join(F.broadcast(hits) if few else hits, "segment_id")
    if cut_first:
        best = points.best_per_group(rows, ["query_id"], F.col("chunk_id")).drop("rank")
        rows = points.ranked(best, ["query_id"], [F.desc("score"), F.col("segment_id")], wanted)
    shown = present.limited(present.project(rows))
    if reranker:
        shown = shown.checkpoint()
        lap("retrieval")
        heroes = shown.where((F.col("rank") <= settings.rerank_max_candidates) & F.col("hero_page").isNotNull())
        seen = index.page_images(heroes.select(F.col("file_sha256").alias("sha"), F.col("hero_page").alias("page")))
        shown = reranked(shown, queries, reranker, settings.rerank_max_candidates, seen, settings.rerank_timeout)
    else:
        shown = shown.withColumn("rerank_reason", F.lit(None).cast("string"))
    shown = shown.where(F.col("rank") <= k).checkpoint()
    lap("rerank" if reranker else "retrieval")
    mode, images = image_mode or settings.include_page_images_default, None
    if mode != "none":
        wanted = shown.where(F.size("page_refs") > 0).select(F.col("file_sha256").alias("sha"), F.explode("page_refs").alias("page"))
        images = index.page_files(wanted) if mode == "path" else index.page_images(wanted)
    shown = present.attach_pages(shown, images, mode, f"{index.root}/page_files")
    directories = shown.select(dirname(F.col("path")).alias("directory")).distinct()
    entries = directory_entries(directories, settings.location_respect_gitignore)
    kept = entries.where(~listing.ignored(F.col("name"), listing.ignore_patterns(F.col("rules"))))
    located = present.attach_location(shown, listing.directory_listings(kept, settings.location_directory_listing_max))
    results = located.checkpoint()
    lap("formatting")
    timing["total"] = (time.time() - clock) * 1000
    return Answer(queries, results, done, "partial" if errors else "complete", errors, timing)
