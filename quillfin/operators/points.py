"""Points: one row per (chunk, modality), the unit that is stored and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.functions.text import is_blank, strip
from quillfin.operators.skew import keyed_filter

def file_type_of(kind: Column) -> Column:
    return F.when(kind == "pdf_topic", "pdf").when(kind == "text_topic", "text").otherwise("image")


def point_id(chunk_id: Column, modality: Column) -> Column:
    """Stable id, so that re-running an ingest reproduces it."""
    return F.sha2(F.concat_ws("|", chunk_id, modality), 256)


def page_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each page: its segments in order, empty ones left out, joined by newlines, stripped."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("ord", "text"))))
    return segments.groupBy(*keys, "page").agg(
        strip(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n")).alias("page_text")
    )


def chunk_pages(chunks: DataFrame, pages: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks with ``pages``: an array of ``(pos, page, columns...)`` structs in ``page_refs`` order.

    Pages missing on the page side are dropped. ``page_refs`` is bounded by the page cap.
    """
    ids = ["path", "chunk_id"]
    refs = chunks.select(*ids, F.posexplode("page_refs").alias("pos", "page"))
    found = refs.join(pages.select("path", "page", *columns), ["path", "page"])
    gathered = found.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "page", *columns))).alias("pages"))
    return chunks.join(gathered, ids, "left")


def header(title: Column, summary: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit(""))))


def _joined(head: Column, parts: Column) -> Column:
    heads = F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(heads, F.coalesce(parts, F.array().cast("array<string>"))), "\n\n")


def pdf_body(title: Column, summary: Column, pages: Column) -> Column:
    """Header, then ``[page N]`` blocks of pages that have text."""
    full = F.filter(pages, lambda p: F.coalesce(p["page_text"], F.lit("")) != "")
    blocks = F.transform(full, lambda p: F.concat(F.lit("[page "), p["page"].cast("string"), F.lit("]\n"), p["page_text"]))
    return _joined(header(title, summary), blocks)


def text_body(title: Column, summary: Column, slices: Column) -> Column:
    """Header, then the chunk's slices of the file text."""
    return _joined(header(title, summary), slices)


def image_body(title: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(header(title, summary), F.lit("")), title)


def visual_multivector(pages: Column) -> Column:
    """Page multivectors concatenated in page order; pages without vectors drop out, none gives null."""
    vectors = F.flatten(F.filter(F.transform(pages, lambda p: p["vectors"]), lambda v: v.isNotNull()))
    return F.when(F.size(vectors) > 0, vectors)


def modality_rows(chunks: DataFrame, body: Column, has_image: Column) -> DataFrame:
    """Route chunks to points: a text point unless the body is blank, an image point if there is one.

    Text files never get an image point. The whole body is embedded.
    """
    text = F.when(~is_blank(body), F.struct(F.lit("text").alias("modality"), body.alias("embed_text")))
    image = F.when(
        has_image & (F.col("kind") != "text_topic"),
        F.struct(F.lit("image").alias("modality"), F.lit(None).cast("string").alias("embed_text")),
    )
    return (
        chunks.withColumn("_p", F.explode(F.array_compact(F.array(text, image))))
        .select(*chunks.columns, "_p.modality", "_p.embed_text")
    )


def materialise(rows: DataFrame) -> DataFrame:
    """Stored payload of a point. Page only with page refs; lines are those of the first range."""
    first = F.try_element_at("line_ranges", F.lit(1))
    return rows.select(
        point_id(F.col("chunk_id"), F.col("modality")).alias("segment_id"),
        "path",
        file_type_of(F.col("kind")).alias("file_type"),
        "modality",
        F.when(F.size("page_refs") > 0, F.col("hero_page")).alias("page"),
        first["start"].alias("start_line"),
        first["end"].alias("end_line"),
        *[c for c in rows.columns if c not in ("path", "modality")],
    )


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version per key. A mergeable aggregate, so a key may be rewritten any number of times."""
    payload = [c for c in rows.columns if c not in (key, version)]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*payload), version).alias("p"), F.max(version).alias(version))
        .select(key, version, *[F.col(f"p.{c}").alias(c) for c in payload])
    )


def live(points: DataFrame, tombstones: DataFrame | None, key: str = "segment_id", version: str = "version") -> DataFrame:
    """Rows that no later tombstone covers; a row written with or after its tombstone lives.

    For rows that are not files of an index, as their keys may have to be shuffled; what is stored goes by
    positions (``operators.positions``).
    """
    if tombstones is None:
        return points
    gone = tombstones.groupBy(F.col(key).alias("_k")).agg(F.max(version).alias("gone_at"))
    return points.join(gone, (F.col(key) == F.col("_k")) & (F.col("gone_at") > F.col(version)), "left_anti")


def in_paths(points: DataFrame, paths: DataFrame | list[str] | None) -> DataFrame:
    """Exact path membership; ``None`` is no filter, an empty list keeps nothing."""
    if paths is None:
        return points
    if isinstance(paths, list):
        return points.where(F.col("path").isin(paths) if paths else F.lit(False))
    return keyed_filter(points, paths, "path", "segment_id")


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark trims every partition to ``k`` before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def best_per_group(scored: DataFrame, keys: list[str], group: Column, score: str = "score", tie: str = "segment_id") -> DataFrame:
    """Keep each group's best row (highest score, lowest id); a null or empty group stands for itself."""
    payload = [c for c in scored.columns if c not in keys]
    grouped = scored.withColumn("_g", F.coalesce(F.nullif(group, F.lit("")), F.col(tie)))
    order = F.struct((-F.col(score)).alias("a"), F.col(tie).alias("b"))
    return (
        grouped.groupBy(*keys, "_g").agg(F.min_by(F.struct(*payload), order).alias("r"))
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in payload])
    )
