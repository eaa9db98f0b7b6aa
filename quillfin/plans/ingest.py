"""Incremental ingest: find files, plan the stale ones, embed their chunks, append to the index."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.functions import jsonx
from quillfin.functions.text import basename, is_blank, language_hint
from quillfin.models.embed import Embedder, embed
from quillfin.models.limits import until
from quillfin.models.topics import TopicModel, text_prompt, text_replies
from quillfin.operators import chunking, listing, points, state, topics
from quillfin.session import checkpoint_dir, ship_package
from quillfin.settings import Settings
from quillfin.sources import files as fs
from quillfin.sources.content import decode_text
from quillfin.sources.index import POINT, Index, Run
from quillfin.sources.manifests import Conflict
from quillfin.sources.pdf import REPLY, PdfReader, pdf_pages, pdf_replies

CHUNK = (
    "path string, chunk_id string, file_sha256 string, kind string, title string, summary string, page_refs array<int>, "
    "line_ranges array<struct<start:int,end:int>>, char_ranges array<struct<start:int,end:int>>, order_key int, hero_page int, "
    "excerpt string, body string, image_vectors array<array<float>>"
)
SKIP = "path string, reason string"
_PAYLOAD = [f.strip().split(" ")[0] for f in POINT.replace("<start:int,end:int>", "").split(",")]


@dataclass
class Ingested:
    stats: DataFrame  # files_added, files_updated, files_skipped_unchanged
    skipped: DataFrame  # path, reason
    files: DataFrame  # path of every supported file found
    version: int


@dataclass
class Models:
    """Plug points. Without a topic model text and PDF files are skipped, never cut by rule."""

    embedder: Embedder
    topics: TopicModel | None = None
    pdf: PdfReader | None = None


# How often an ingest is planned anew because another writer committed meanwhile.
COMMIT_TRIES = 5


def ingest(
    index: Index, paths: list[str], models: Models, settings: Settings, force: bool = False, purge: bool = True
) -> Ingested:
    """Bring what the index holds of ``paths`` up to date, in one version.

    If another writer commits first, the files are compared with what that one wrote and the rest is done.
    """
    started = time.time()
    for _ in range(COMMIT_TRIES):
        try:
            return _ingest(index, paths, models, settings, force, purge, started)
        except Conflict as exc:
            lost = exc
            index.reload()
    raise lost


def _ingest(
    index: Index, paths: list[str], models: Models, settings: Settings, force: bool, purge: bool, started: float
) -> Ingested:
    paths = [os.path.realpath(p) for p in paths]
    spark = index.spark
    ship_package(spark)
    checkpoint_dir(spark)
    found, left_out = fs.walk(spark, paths, settings)
    looked_at = fs.inspect(found.repartition("path")).checkpoint()
    supported = looked_at.where("file_type IS NOT NULL")
    unsupported = looked_at.where("file_type IS NULL").select("path", F.lit("unsupported file type").alias("reason"))

    planned = state.staleness(supported, index.state())
    if force:
        planned = planned.withColumn("action", F.when(F.col("action") == "unchanged", "changed").otherwise(F.col("action")))
    planned = planned.checkpoint()
    stale = planned.where("action <> 'unchanged'").select("path", "content_hash_sha256", "file_type")
    # With purging, what the index holds under the paths is what was found there.
    gone = state.orphaned_files(index.state(), supported, paths).checkpoint() if purge else None
    if stale.isEmpty() and (gone is None or gone.isEmpty()):
        return Ingested(_stats(planned, planned.select("path")), left_out.unionByName(unsupported), supported.select("path"), index.version)

    run = index.begin()
    version = run.version
    # Files whose models are not done by then are named as late; all others are indexed.
    chunks, failed = _plan(run, stale, models, settings, started + settings.indexing_timeout)
    run.append("points", _points(chunks, models.embedder, settings, version))
    # From here on the written rows are the source, so no model runs twice.
    written = run.written("points", POINT).select("path", "segment_id", F.col("vectors").isNull().alias("lost"))
    made = written.where("NOT lost").groupBy("path").agg(F.sort_array(F.collect_list("segment_id")).alias("_ids"))
    refused = written.where("lost").groupBy("path").agg(
        F.format_string("embed error: %d chunks could not be embedded", F.count("*")).alias("reason")
    )
    done = planned.where("action <> 'unchanged'").join(failed, "path", "left_anti")
    dead = [state.superseded_points(done, version).select("segment_id")]
    run.append(
        "state",
        done.drop("point_ids").join(made, "path", "left").select(
            "path", "size", "mtime_ns", "content_hash_sha256",
            F.lit(time.time()).alias("last_indexed_at"),
            F.coalesce("_ids", F.array().cast("array<string>")).alias("point_ids"),
            F.coalesce(F.size("_ids"), F.lit(0)).alias("n_points"),
            F.lit(version).cast("long").alias("version"),
        ),
    )
    if gone is not None:
        dead.append(gone.select(F.explode("point_ids").alias("segment_id")))
        run.append("state", _gone_rows(gone, version))
    run.delete(reduce(DataFrame.unionByName, dead))
    run.commit()
    skipped = reduce(DataFrame.unionByName, [left_out, unsupported, failed, refused])
    finished = planned.select("path").join(failed, "path", "left_anti")
    return Ingested(_stats(planned, finished), skipped, supported.select("path"), version)


def nothing_ingested(index: Index, paths: list[str]) -> Ingested:
    """What there is to say when an ingest failed: the files that the index has under the paths."""
    held = index.state().select("path").where(listing.under(F.col("path"), paths))
    none = state.ingest_stats(index.spark.createDataFrame([], "path string, action string, point_ids array<string>"))
    return Ingested(none, index.spark.createDataFrame([], SKIP), held, index.version)


def _stats(planned: DataFrame, finished: DataFrame) -> DataFrame:
    return state.ingest_stats(planned.join(finished, "path", "left_semi"))


def _gone_rows(gone: DataFrame, version: int) -> DataFrame:
    nothing = F.lit(None)
    return gone.select(
        "path", nothing.cast("long").alias("size"), nothing.cast("long").alias("mtime_ns"),
        nothing.cast("string").alias("content_hash_sha256"), F.lit(time.time()).alias("last_indexed_at"),
        F.array().cast("array<string>").alias("point_ids"), F.lit(0).alias("n_points"), F.lit(version).cast("long").alias("version"),
    )


def _plan(
    run: Run, stale: DataFrame, models: Models, settings: Settings, deadline: float
) -> tuple[DataFrame, DataFrame]:
    """(chunks with bodies, files that failed with a reason) over all file types."""
    chunks, failed = [_image_chunks(stale, models)], []
    for kind, plan, missing in (
        ("text", _text_chunks, None if models.topics else "plan error: no topic model"),
        ("pdf", _pdf_chunks, None if models.topics and models.pdf else "plan error: no topic model or PDF reader"),
    ):
        mine = stale.where(F.col("file_type") == kind)
        if missing:
            failed.append(mine.select("path", F.lit(missing).alias("reason")))
        else:
            made, lost = plan(run, mine, models, settings, deadline)
            chunks.append(made)
            failed.append(lost)
    return reduce(DataFrame.unionByName, chunks), reduce(DataFrame.unionByName, failed)


def chunk_id(path, sha, part):
    return F.sha2(F.concat_ws("|", path, sha, part), 256)


def _shaped(df: DataFrame) -> DataFrame:
    """Columns of ``CHUNK`` in order, missing ones empty."""
    out = []
    for field in df.sparkSession.createDataFrame([], CHUNK).schema:
        if field.name in df.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.dataType.typeName() == "array" and field.name != "image_vectors":
            out.append(F.array().cast(field.dataType).alias(field.name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*out)


def _image_chunks(stale: DataFrame, models: Models) -> DataFrame:
    """One chunk per image file, with the image's vectors if the embedder sees images and its text if the
    reader has OCR; either may fail for an image, which then goes without."""
    from quillfin.models.embed import embed_images
    from quillfin.sources.pdf import image_texts

    name = basename(F.col("path"))
    own = stale.where("file_type = 'image'")
    sees, reads = hasattr(models.embedder, "embed_images"), hasattr(models.pdf, "ocr")
    if sees or reads:
        content = fs.with_content(own).select("path", "content_hash_sha256", "content")
        own = image_texts(content, models.pdf) if reads else content.withColumn("ocr_text", F.lit(""))
        own = embed_images(own, "content", models.embedder, "image_vectors") if sees else own.drop("content")
    else:
        own = own.withColumn("ocr_text", F.lit(""))
    images = own.select(
        "path",
        chunk_id("path", "content_hash_sha256", F.lit("0")).alias("chunk_id"),
        F.col("content_hash_sha256").alias("file_sha256"),
        F.lit("image").alias("kind"),
        name.alias("title"),
        F.lit("standalone image").alias("summary"),
        F.when(is_blank(F.col("ocr_text")), name).otherwise(F.col("ocr_text")).alias("excerpt"),
        F.lit(0).alias("order_key"),
        "ocr_text",
        *(["image_vectors"] if sees else []),
    )
    words = F.when(~is_blank(F.col("ocr_text")), F.col("ocr_text"))
    return _shaped(images.withColumn("body", F.concat_ws("\n\n", points.image_body(F.col("title"), F.col("summary")), words)))


def _filled_late(pages: DataFrame) -> DataFrame:
    """Replies of files whose job was ended: none, and late."""
    none = pages.sparkSession.createDataFrame([], REPLY)
    return none.unionByName(pages.select("path").distinct().withColumn("late", F.lit(True)), allowMissingColumns=True)


def _late_files(replies: DataFrame) -> DataFrame:
    return replies.where("late").select("path").distinct().select("path", F.lit("indexing timeout").alias("reason"))


def _text_chunks(
    run: Run, stale: DataFrame, models: Models, settings: Settings, deadline: float
) -> tuple[DataFrame, DataFrame]:
    texts = fs.with_content(stale).select("path", "content_hash_sha256", decode_text("content").alias("text"))
    filled = texts.where(~is_blank(F.col("text")))
    windows = chunking.window_texts(filled.select("path", "text"), "text", settings.chunker_vlm_ctx_tokens)
    asked = windows.select(
        "path",
        "window_no",
        (F.col("last_line") - F.col("first_line") + 1).alias("n_lines"),
        (F.col("first_line") - 1).alias("line_offset"),
        text_prompt(F.col("window_text"), language_hint(F.col("path"))).alias("prompt"),
    )
    replies = until(stale.sparkSession, deadline, lambda: text_replies(asked, models.topics, deadline, settings.model_timeout).checkpoint())
    if replies is None:
        replies = asked.withColumn("prompt", F.lit(None).cast("string")).withColumnRenamed("prompt", "reply").withColumn("late", F.lit(True))
    late = _late_files(replies)
    found = jsonx.parse_text_topics(replies)
    silent = replies.select("path", "window_no").join(found.select("path", "window_no").distinct(), ["path", "window_no"], "left_anti")
    useless = silent.select("path").distinct().join(late, "path", "left_anti")
    failed = useless.select("path", F.lit("plan error: the topic model gave no usable topics").alias("reason")).unionByName(late)
    spans = found.join(failed, "path", "left_anti").select(
        "path", (F.col("window_no").cast("long") * 100_000 + F.col("ord")).alias("ord"), "title", "summary", F.explode("ranges").alias("r")
    ).select("path", "ord", "title", "summary", "r.start", "r.end")
    heads, merged = topics.coalesce_titles(spans)
    # Everything below is per file, and a file is one row of text.
    ranges = merged.groupBy("path", "title_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("range_start").alias("start"), F.col("range_end").alias("end")))).alias("line_ranges")
    )
    of_file = heads.join(ranges, ["path", "title_key"]).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("first_ord", "title_key", "title", "summary", "line_ranges"))).alias("topics")
    )
    with_text = (
        filled.join(of_file, "path")
        .withColumn("starts", chunking.line_starts("text"))
        .withColumn("lines", F.split("text", "\n"))
    )

    def located(t):
        spots = chunking.char_ranges(t["line_ranges"], F.col("starts"), F.length("text"))
        return F.struct(
            t["title"].alias("title"),
            t["summary"].alias("summary"),
            t["line_ranges"].alias("line_ranges"),
            spots.alias("char_ranges"),
            chunking.excerpt(F.col("lines"), t["line_ranges"]).alias("excerpt"),
            chunking.text_slices(F.col("text"), spots).alias("slices"),
        )

    # Topics take their pieces before they become rows, so the text is not repeated per topic.
    placed = with_text.withColumn("placed", F.transform("topics", located)).select(
        "path", "content_hash_sha256", F.posexplode("placed").alias("order_key", "t")
    )
    made = placed.select(
        "path",
        chunk_id("path", "content_hash_sha256", F.col("order_key").cast("string")).alias("chunk_id"),
        F.col("content_hash_sha256").alias("file_sha256"),
        F.lit("text_topic").alias("kind"),
        F.col("t.title").alias("title"),
        F.col("t.summary").alias("summary"),
        "t.line_ranges",
        "t.char_ranges",
        "order_key",
        F.col("t.excerpt").alias("excerpt"),
        "t.slices",
    )
    body = points.text_body(F.col("title"), F.col("summary"), F.col("slices"))
    return _shaped(made.withColumn("body", body)), failed


def _pdf_chunks(
    run: Run, stale: DataFrame, models: Models, settings: Settings, deadline: float
) -> tuple[DataFrame, DataFrame]:
    content = fs.with_content(stale)
    pages = pdf_pages(content, models.pdf, settings).checkpoint()
    named = stale.select("path", F.col("content_hash_sha256").alias("sha"))
    run.append(
        "pages",
        pages.where("image IS NOT NULL").join(named, "path").select(
            "sha", "page", "image", F.length("image").cast("long").alias("bytes"), F.lit(run.version).cast("long").alias("version")
        ),
    )
    every = until(stale.sparkSession, deadline, lambda: pdf_replies(content, models.pdf, models.topics, settings, deadline).checkpoint())
    if every is None:
        every = _filled_late(pages)
    late = _late_files(every)
    replies = every.join(late, "path", "left_anti")
    parsed = jsonx.parse_page_topics(replies, settings.chunker_max_topics_per_call)
    stride, cold, cap = settings.chunker_stride_pages, settings.chunker_topic_cold_pages, settings.chunker_topic_max_pages
    in_time = pages.select("path", "page").join(late, "path", "left_anti")
    assigned = parsed.unionByName(topics.unparsed_windows(in_time, parsed, stride))
    if stride == 1:
        chunks = topics.topic_chunks(topics.topic_sessions(assigned, cold, cap))
    else:
        newest = replies.select("path", "window_no", F.array_max("pages").alias("newest"))
        chunks = topics.window_chunks(assigned.join(newest, ["path", "window_no"]), cold, cap)
    folded = chunks.join(stale.select("path", "content_hash_sha256"), "path")
    named = folded.select(
        "*",
        chunk_id("path", "content_hash_sha256", F.concat_ws("|", "topic_id", "session", "part")).alias("chunk_id"),
        F.col("content_hash_sha256").alias("file_sha256"),
        F.lit("pdf_topic").alias("kind"),
    )
    with_pages = points.chunk_pages(named, pages, ["page_text"])
    made = with_pages.withColumn("body", points.pdf_body(F.col("title"), F.col("summary"), F.col("pages")))
    unread = stale.join(pages.select("path").distinct(), "path", "left_anti").join(late, "path", "left_anti")
    failed = unread.select("path", F.lit("plan error: no readable pages").alias("reason")).unionByName(late)
    if hasattr(models.embedder, "embed_images"):
        made = _with_page_vectors(made, pages, models)
    return _shaped(made), failed


def _with_page_vectors(chunks: DataFrame, pages: DataFrame, models: Models) -> DataFrame:
    from quillfin.models.embed import embed_images

    vectors = embed_images(pages.where("image IS NOT NULL").select("path", "page", "image"), "image", models.embedder)
    joined = points.chunk_pages(chunks.drop("pages"), vectors, ["vectors"])
    return joined.withColumn("image_vectors", points.visual_multivector(F.col("pages"))).drop("pages")


def _points(chunks: DataFrame, embedder: Embedder, settings: Settings, version: int) -> DataFrame:
    has_image = F.col("image_vectors").isNotNull()
    rows = points.materialise(points.modality_rows(chunks, F.col("body"), has_image).drop("body"))
    seen = embed(rows, "embed_text", embedder, out="text_vectors", window_chars=settings.embed_text_max_chars)
    vectors = F.when(F.col("modality") == "image", F.col("image_vectors")).otherwise(F.col("text_vectors"))
    # A chunk that the model failed on stays as a row without vectors, which no search reads.
    kept = F.col("vectors").isNull() | (F.size("vectors") > 0)
    ready = seen.withColumn("vectors", vectors).where(kept).withColumn("version", F.lit(version).cast("long"))
    return ready.select(*_PAYLOAD)
