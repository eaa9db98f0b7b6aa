"""Turning scored points into result rows, and result rows into JSON or Markdown responses.

A response holds at most ``top_k`` results, so its arrays are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.functions.text import base64_line, basename, clip, dirname, strip
from quillfin.operators.cache import page_path
from quillfin.operators.topics import page_label

RESULT = (
    "rank score path file_type modality page start_line end_line excerpt chunk_id title summary page_refs line_ranges "
    "context_pages location rerank_reason"
).split()


def project(hits: DataFrame) -> DataFrame:
    """Result columns from ranked points; hero page before page, first line range before lines,
    excerpt before summary, empty arrays as null."""
    first = F.try_element_at("line_ranges", F.lit(1))

    def some(c: str) -> Column:
        return F.when(F.size(c) > 0, F.col(c))

    changed = {
        "page": F.coalesce(F.nullif("hero_page", F.lit(0)), F.col("page")),
        "start_line": F.coalesce(first["start"], F.col("start_line")),
        "end_line": F.coalesce(first["end"], F.col("end_line")),
        "excerpt": F.coalesce(F.nullif("excerpt", F.lit("")), F.col("summary"), F.lit("")),
        "page_refs": some("page_refs"),
        "line_ranges": some("line_ranges"),
    }
    return hits.withColumns(changed)


# Characters of a result that are shown; stored values are whole.
SHOWN = {"title": 200, "summary": 500, "excerpt": 2000}


def limited(results: DataFrame) -> DataFrame:
    """Results with their texts at display length."""
    return results.withColumns({c: F.substring(c, 1, n) for c, n in SHOWN.items()})


def attach_pages(results: DataFrame, cache: DataFrame | None, mode: str = "path", root: str = "") -> DataFrame:
    """Add ``context_pages``: one entry per page ref, with image path or base64 where cached.

    ``cache``: ``sha, page, image binary``. ``mode``: path, base64 or none.
    """
    if mode == "none":
        return results.withColumn("context_pages", F.array().cast("array<struct<page:int,page_image_path:string,page_image_b64:string>>"))
    refs = results.where(F.size("page_refs") > 0).select(
        "query_id", "rank", F.col("file_sha256").alias("sha"), F.posexplode("page_refs").alias("pos", "page")
    )
    held = cache.select("sha", F.col("page").cast("int").alias("page"), "image") if mode == "base64" else cache.select("sha", F.col("page").cast("int").alias("page"))
    found = refs.join(held.withColumn("hit", F.lit(True)), ["sha", "page"], "left")
    where = F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), page_path(F.col("sha"), F.col("page")))
    nothing = F.lit(None).cast("string")
    entry = F.struct(
        "pos",
        F.col("page").cast("int").alias("page"),
        (F.when(F.col("hit"), where) if mode == "path" else nothing).alias("page_image_path"),
        (F.when(F.col("hit"), base64_line(F.col("image"))) if mode == "base64" else nothing).alias("page_image_b64"),
    )
    pages = found.groupBy("query_id", "rank").agg(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(e["page"].alias("page"), e["page_image_path"].alias("page_image_path"), e["page_image_b64"].alias("page_image_b64")),
        ).alias("context_pages")
    )
    return results.join(pages, ["query_id", "rank"], "left").withColumn(
        "context_pages", F.coalesce("context_pages", F.array().cast("array<struct<page:int,page_image_path:string,page_image_b64:string>>"))
    )


def attach_location(results: DataFrame, listings: DataFrame) -> DataFrame:
    """Add the ``location`` struct from ``directory_listings`` of the hit's directory."""
    named = listings.select(
        "directory",
        F.struct(
            "directory", F.col("listing").alias("directory_listing"),
            F.col("truncated").alias("listing_truncated"), F.col("total").alias("listing_total"),
        ).alias("location"),
    )
    return results.withColumn("directory", dirname(F.col("path"))).join(named, "directory", "left").drop("directory")


def compact(results: DataFrame) -> DataFrame:
    """Small results: texts of 240 characters, base64 only for the first hero page, 16 listing names."""
    pages = F.col("context_pages")
    has_image = lambda p: F.coalesce(p["page_image_b64"], F.lit("")) != ""
    of_hero = lambda p: F.col("page").isNull() | (p["page"] == F.col("page"))
    # Position of the first image that may stay.
    keep = F.array_position(F.transform(pages, lambda p: has_image(p) & of_hero(p)), True)
    slim = F.transform(
        pages,
        lambda p, i: F.struct(
            p["page"].alias("page"),
            p["page_image_path"].alias("page_image_path"),
            F.when(i + 1 == keep, p["page_image_b64"]).alias("page_image_b64"),
        ),
    )
    names = F.col("location.directory_listing")
    long = F.size(names) > 16
    short = F.when(long, F.concat(F.slice(names, 1, 8), F.array(F.lit("...")), F.slice(names, -8, 8))).otherwise(names)
    location = F.when(
        F.col("location").isNotNull(),
        F.struct(
            F.col("location.directory").alias("directory"), short.alias("directory_listing"),
            (F.coalesce(long, F.lit(False)) | F.col("location.listing_truncated")).alias("listing_truncated"),
            F.col("location.listing_total").alias("listing_total"),
        ),
    )
    return results.withColumns(
        {
            "excerpt": clip(F.col("excerpt"), 240),
            "summary": clip(F.col("summary"), 240),
            "context_pages": slim,
            "location": location,
        }
    )


def trim(results: DataFrame, sizes: DataFrame | None, budget_bytes: int) -> DataFrame:
    """Results for a tool client: hero page only, excerpts of 400 characters, images within a budget; the
    reranker's reason and the location stay if there are any.

    ``sizes``: ``page_image_path, image``. Images are taken in rank order; one that does not fit is
    skipped and does not use up the budget.
    """
    pages = F.col("context_pages")
    wanted = F.filter(
        pages, lambda p: F.coalesce(p["page"] == F.col("page"), F.lit(False)) | F.coalesce(p["page"] == F.get("page_refs", F.lit(0)), F.lit(False))
    )
    hero = F.coalesce(F.get(wanted, F.lit(0)), F.get(pages, F.lit(0)))
    slim = results.withColumn("_hero", hero).select(
        "query_id", "rank", "score", "path", "title", "summary", "page_refs",
        F.substring("excerpt", 1, 400).alias("excerpt"),
        F.col("_hero.page").alias("hero_page"),
        F.col("_hero.page_image_path").alias("hero_page_image_path"),
        *[c for c in ("rerank_reason", "location") if c in results.columns],
    )
    if sizes is None:
        return slim.withColumn("hero_page_image_b64", F.lit(None).cast("string"))
    lengths = sizes.select(F.col("page_image_path").alias("hero_page_image_path"), F.length("image").alias("n"))
    measured = slim.select("query_id", "rank", "hero_page_image_path").join(lengths, "hero_page_image_path")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "n")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def take(state: Column, x: Column) -> Column:
        fits = (x["n"] > 0) & (state["used"] + x["n"] <= budget_bytes)
        return F.when(
            fits, F.struct((state["used"] + x["n"]).alias("used"), F.concat(state["kept"], F.array(x["rank"])).alias("kept"))
        ).otherwise(state)

    kept = measured.groupBy("query_id").agg(F.aggregate(ordered, start, take, lambda s: s["kept"]).alias("kept"))
    inlined = slim.join(kept, "query_id", "left").withColumn(
        "_path", F.when(F.array_contains("kept", F.col("rank")), F.col("hero_page_image_path"))
    )
    images = sizes.select(F.col("page_image_path").alias("_path"), base64_line(F.col("image")).alias("hero_page_image_b64"))
    return inlined.join(images, "_path", "left").drop("_path", "kept")


def responses(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One row per request with its ``results`` array in rank order.

    ``requests``: ``query_id, query, status, files_added, files_updated, files_skipped_unchanged,
    skipped array<struct<path,reason>>, errors array<string>, total_ms``.
    """
    fields = [c for c in RESULT if c in results.columns]
    gathered = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["rank"] - b["rank"]).alias("results"))
    shape = results.select(F.array(F.struct(*fields)).alias("r")).schema["r"].dataType
    return requests.join(gathered, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast(shape)))


def as_json(response: DataFrame, pretty: bool = True) -> DataFrame:
    body = F.struct(*[c for c in response.columns if c != "query_id"])
    options = {"pretty": "true" if pretty else "false", "ignoreNullFields": "false"}
    return response.select("query_id", F.to_json(body, options).alias("response"))


def _lines(*parts: Column) -> Column:
    """One flat array of lines from arrays of lines."""
    return F.flatten(F.array(*parts))


def _one(*texts: Column | str) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])


_NO_LINES = "array<string>"


def _if(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast(_NO_LINES))


def as_markdown(response: DataFrame) -> DataFrame:
    """Plain Markdown: header, index counters, one block per result, skipped files, errors."""

    def block(r: Column) -> Column:
        place = F.when(r["page"].isNotNull(), F.concat(F.lit(" | **Page**: "), r["page"])).when(
            r["start_line"].isNotNull() & r["end_line"].isNotNull(),
            F.concat(F.lit(" | **Lines**: "), r["start_line"], F.lit("-"), r["end_line"]),
        ).otherwise("")
        return _one(
            F.concat(F.lit("### "), r["rank"], F.lit(". "), r["path"], F.lit(" (score: "), r["score"], F.lit(")")),
            F.concat(F.lit("**Type**: "), r["file_type"], F.lit(" | **Modality**: "), r["modality"], place),
            F.concat(F.lit("> "), clip(F.coalesce(r["excerpt"], F.lit("")), 200)),
            "",
        )

    head = _one(
        F.concat(F.lit('# Search Results: "'), "query", F.lit('"')),
        "",
        F.concat(F.lit("**Status**: "), "status", F.lit(" | **Total**: "), F.size("results"), F.lit(" results | **Time**: "), "total_ms", F.lit("ms")),
        "",
        "## Indexing",
        F.concat(F.lit("- Added: "), "files_added", F.lit(" files | Updated: "), "files_updated", F.lit(" | Skipped (unchanged): "), "files_skipped_unchanged"),
        "",
    )
    body = _lines(
        head,
        _if(F.size("results") > 0, _lines(_one("## Results", ""), F.flatten(F.transform("results", block)))),
        _if(F.size("skipped") > 0, _lines(_one("## Skipped Files", ""), F.transform("skipped", lambda s: F.concat(F.lit("- "), s["path"], F.lit(": "), s["reason"])), _one(""))),
        _if(F.size("errors") > 0, _lines(_one("## Errors", ""), F.transform("errors", lambda e: F.concat(F.lit("- "), e)), _one(""))),
    )
    return response.select("query_id", F.array_join(body, "\n").alias("response"))


def as_rich_markdown(response: DataFrame) -> DataFrame:
    """Markdown with titles, pages, line ranges, reasons, quoted excerpts, images and locations."""

    def block(r: Column) -> Column:
        bits = F.array_compact(
            F.array(
                F.concat(F.lit("**File**: `"), r["path"], F.lit("`")),
                F.when(F.size(r["page_refs"]) > 0, F.concat(F.lit("**Pages**: "), page_label(r["page_refs"]))),
                F.when(
                    F.size(r["line_ranges"]) > 0,
                    F.concat(F.lit("**Lines**: "), F.array_join(F.transform(r["line_ranges"], lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ", ")),
                ),
                F.concat(F.lit("**Modality**: "), r["modality"]),
            )
        )
        images = F.array_compact(
            F.transform(
                r["context_pages"],
                lambda p: F.when(
                    p["page_image_path"].isNotNull(),
                    F.concat(F.lit("![page "), p["page"], F.lit("](file://"), p["page_image_path"], F.lit(")")),
                ).when(
                    p["page_image_b64"].isNotNull(),
                    F.concat(F.lit("![page "), p["page"], F.lit("](data:image/webp;base64,"), p["page_image_b64"], F.lit(")")),
                ),
            )
        )
        quote = clip(strip(r["excerpt"]), 600)
        place = r["location"]
        names = place["directory_listing"]
        count = F.concat(
            F.lit("Directory contents ("), place["listing_total"], F.when(place["listing_truncated"], ", truncated").otherwise(""), F.lit("):")
        )
        filled = lambda c: F.coalesce(c, F.lit("")) != ""
        return _lines(
            _one(
                F.concat(
                    F.lit("## "), r["rank"], F.lit(". "), F.coalesce(F.nullif(r["title"], F.lit("")), basename(r["path"])),
                    F.lit("  (score "), F.format_string("%.3f", r["score"]), F.lit(")"),
                ),
                F.array_join(bits, " · "),
            ),
            _if(filled(r["summary"]), _one(F.concat(F.lit("_"), r["summary"], F.lit("_")))),
            _if(filled(r["rerank_reason"]), _one(F.concat(F.lit("> **Rerank reason:** "), r["rerank_reason"]))),
            _if(filled(r["excerpt"]), _lines(_one(""), F.transform(F.split(quote, "\n"), lambda x: F.concat(F.lit("> "), x)))),
            _if(F.size(r["context_pages"]) > 0, _lines(_one(""), images)),
            _if(
                place.isNotNull(),
                _lines(
                    _one("", F.concat(F.lit("**Location**: `"), place["directory"], F.lit("`"))),
                    _if(F.size(names) > 0, _lines(_one(count), F.transform(names, lambda n: F.concat(F.lit("  - "), n)))),
                ),
            ),
            _one(""),
        )

    touched = (F.col("files_added") > 0) | (F.col("files_updated") > 0) | (F.col("files_skipped_unchanged") > 0)
    body = _lines(
        _one(
            F.concat(F.lit('# Search: "'), "query", F.lit('"')),
            "",
            F.concat(
                F.lit("**Status**: "), "status", F.lit(" · **Results**: "), F.size("results"),
                F.lit(" · **Time**: "), F.format_string("%.0f", F.col("total_ms").cast("double")), F.lit(" ms"),
            ),
            "",
        ),
        _if(
            touched,
            _one(
                F.concat(
                    F.lit("Indexed: +"), "files_added", F.lit(" added, ~"), "files_updated",
                    F.lit(" updated, ="), "files_skipped_unchanged", F.lit(" unchanged"),
                ),
                "",
            ),
        ),
        F.when(F.size("results") > 0, F.flatten(F.transform("results", block))).otherwise(_one("_No results._", "")),
        _if(F.size("skipped") > 0, _lines(_one("## Skipped"), F.transform("skipped", lambda s: F.concat(F.lit("- `"), s["path"], F.lit("`: "), s["reason"])), _one(""))),
        _if(F.size("errors") > 0, _lines(_one("## Errors"), F.transform("errors", lambda e: F.concat(F.lit("- "), e)), _one(""))),
    )
    return response.select("query_id", F.array_join(body, "\n").alias("response"))


def recent(log: DataFrame, order: str, tie: str, n: int = 20) -> DataFrame:
    """Newest entries of a query log, newest first; of equally new ones the higher ``tie`` first."""
    return log.orderBy(F.desc(order), F.desc(tie)).limit(n)
