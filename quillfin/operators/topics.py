"""Topics: pages carry topic assignments, topics become chunks.

``assignments`` rows: ``path, page, ord, topic_id, is_continuation, title, summary`` - page numbers
may have holes, a page may carry several topics, ``ord`` is the position within the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.functions.text import strip, title_key
from quillfin.operators.running import Running, key_blocks, running

PAGE_BLOCK = 4096  # pages of one file handled by one window group


def topic_pages(assignments: DataFrame) -> DataFrame:
    """One row per (path, topic, page): the first assignment wins, pages repeat no more."""
    head = F.min_by(F.struct("title", "summary", "is_continuation"), "ord")
    return (
        assignments.groupBy("path", "topic_id", "page")
        .agg(head.alias("h"), F.min("ord").alias("ord"))
        .select("path", "topic_id", "page", "ord", "h.title", "h.summary", "h.is_continuation")
    )


def topic_sessions(
    assignments: DataFrame, cold_pages: int = 20, max_pages: int = 15, block: int = PAGE_BLOCK
) -> DataFrame:
    """Add ``session`` and ``part``: the chunk a topic page belongs to when windows are one page wide.

    A topic is closed once the newest page of its file is ``cold_pages`` past its last page, and
    whenever it has ``max_pages`` pages; a later page of a closed topic opens a new chunk. The newest
    page before a row is a running maximum over the file, the topic's last page one over the topic.
    """
    by_block = key_blocks(assignments, ["path"], F.floor(F.col("page") / block))
    pages = assignments.select("path", "page").distinct()
    newest = running(pages, ["path"], [F.col("page")], by_block, [Running("newest", "max", F.col("page"), before=True)])
    rows = topic_pages(assignments).join(newest, ["path", "page"])
    order = [F.col("page")]
    last = running(
        rows, ["path", "topic_id"], order, by_block,
        [Running("last_page", "max", F.col("page"), before=True), Running("nth", "count", F.lit(1))],
    ).withColumn("opens", F.col("last_page").isNull() | (F.col("newest") - F.col("last_page") >= cold_pages))
    placed = running(
        last, ["path", "topic_id"], order, by_block,
        [
            Running("session", "sum", F.col("opens").cast("int")),
            Running("first_nth", "max", F.when(F.col("opens"), F.col("nth"))),
        ],
    )
    return placed.withColumn("part", F.floor((F.col("nth") - F.col("first_nth")) / max_pages).cast("int")).drop(
        "newest", "last_page", "nth", "opens", "first_nth"
    )


def topic_chunks(sessions: DataFrame) -> DataFrame:
    """Fold session pages into chunks; a chunk holds at most ``max_pages`` pages by construction."""
    first = F.min_by(F.struct("title", "summary", "page"), "page")
    title = F.coalesce(F.nullif(F.col("f.title"), F.lit("")), F.concat(F.lit("Topic starting on p."), F.col("f.page")))
    summary = F.coalesce(F.col("f.summary"), F.lit(""))
    return (
        sessions.groupBy("path", "topic_id", "session", "part")
        .agg(first.alias("f"), F.sort_array(F.collect_set("page")).alias("page_refs"))
        .select(
            "path",
            "topic_id",
            "session",
            "part",
            title.alias("title"),
            summary.alias("summary"),
            "page_refs",
            F.col("f.page").alias("hero_page"),
            strip(F.concat(title, F.lit("\n"), summary)).alias("excerpt"),
            F.col("f.page").alias("order_key"),
        )
    )


def unparsed_windows(pages: DataFrame, assignments: DataFrame, stride: int, block: int = PAGE_BLOCK) -> DataFrame:
    """Assignments for page windows the topic model failed on: one topic per tumbling window.

    Windows are ``stride`` consecutive existing pages of a file; a window without any assignment
    becomes an "Unparsed window" topic covering its pages.
    """
    numbered = page_windows(pages, stride, block)
    covered = numbered.join(assignments.select("path", "page").distinct(), ["path", "page"], "left_semi")
    failed = numbered.join(covered.select("path", "window_no").distinct(), ["path", "window_no"], "left_anti")
    edges = Window.partitionBy("path", "window_no")
    lo, hi = F.min("page").over(edges), F.max("page").over(edges)
    return failed.select(
        "path",
        "page",
        "window_no",
        F.lit(0).alias("ord"),
        F.concat(F.lit("unparsed_"), F.col("window_no")).alias("topic_id"),
        F.lit(False).alias("is_continuation"),
        F.concat(F.lit("Unparsed window (pages "), lo, F.lit("–"), hi, F.lit(")")).alias("title"),
        F.lit("The topic model returned nothing usable for this window.").alias("summary"),
    )


def page_windows(pages: DataFrame, stride: int, block: int = PAGE_BLOCK) -> DataFrame:
    """Tumbling windows of ``stride`` existing pages; the last window of a file may be short."""
    existing = pages.select("path", "page").distinct()
    by_block = key_blocks(pages, ["path"], F.floor(F.col("page") / block))
    counted = running(existing, ["path"], [F.col("page")], by_block, [Running("nth", "count", F.lit(1))])
    return counted.withColumn("window_no", F.floor((F.col("nth") - 1) / stride)).drop("nth")


WINDOW_CHUNK = "path string, title string, summary string, page_refs array<int>, hero_page int, part int"


def window_chunks(assignments: DataFrame, cold_pages: int = 20, max_pages: int = 15) -> DataFrame:
    """Chunks for windows of several pages, where topics close only at window ends.

    How far a topic overruns its page cap depends on every earlier window, so a file is folded in
    order. The rows of a file come from one reader of one file, which bounds the group.
    ``assignments`` also has ``window_no`` and ``newest``, the last page of the window.
    """
    from quillfin.models.topics import OpenTopics

    def fold(key, rows):
        import pandas as pd

        state = OpenTopics(cold_pages, max_pages)
        rows = rows.sort_values(["window_no", "page", "ord"])
        for _, window in rows.groupby("window_no", sort=True):
            listed = zip(window["page"], window["topic_id"], window["title"], window["summary"])
            state.window([(int(p), t, n, s) for p, t, n, s in listed], int(window["newest"].iloc[0]))
        made = [
            (key[0], title, summary, sorted(pages), hero, n)
            for n, (_, (title, summary, pages, hero)) in enumerate(state.finish())
        ]
        return pd.DataFrame(made, columns=["path", "title", "summary", "page_refs", "hero_page", "part"])

    rows = assignments.select("path", "window_no", "newest", "page", "ord", "topic_id", "title", "summary")
    folded = rows.groupBy("path").applyInPandas(fold, WINDOW_CHUNK)
    text = F.concat("title", F.lit("\n"), "summary")
    return folded.withColumns(
        {"excerpt": strip(text), "order_key": F.col("hero_page"), "topic_id": F.lit("window"), "session": F.lit(0)}
    )


def coalesce_titles(topics: DataFrame, block: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge topics of overlapping windows that share a title: ``(heads, ranges)``.

    ``topics``: ``path, ord, title, summary, start, end`` with ``ord`` the position in the file.
    The first title and the longest summary (the first of equals) survive. Heads come from mergeable
    aggregates and ranges stay rows, so a title may own any share of the input.
    """
    keyed = topics.withColumn("title_key", title_key(F.col("title")))
    # Ordered by (longest summary, earliest): the minimum of (-length, ord) picks it.
    longest = F.struct((-F.length("summary")).alias("n"), "ord")
    heads = keyed.groupBy("path", "title_key").agg(
        F.min_by("title", "ord").alias("title"),
        F.min_by("summary", longest).alias("summary"),
        F.min("ord").alias("first_ord"),
    )
    spans = merge_range_rows(keyed.select("path", "title_key", "start", "end"), ["path", "title_key"], block)
    return heads, spans


def merge_range_rows(ranges: DataFrame, keys: list[str], block: Column | None = None) -> DataFrame:
    """Merge overlapping and adjacent integer ranges per key; one row per merged range.

    A range opens an island when it starts more than one past everything before it; the island is
    named by its start, so merging is a plain ``max(end)``.
    """
    block = key_blocks(ranges, keys, F.floor(F.col("start") / PAGE_BLOCK) if block is None else block)
    # Ranges with one start collapse to the longest before anything is ordered.
    valid = ranges.where("start <= end").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    order = [F.col("start")]
    reach = running(valid, keys, order, block, [Running("reach", "max", F.col("end"), before=True)])
    opens = F.coalesce(F.col("start") > F.col("reach") + 1, F.lit(True))
    named = running(reach, keys, order, block, [Running("island", "max", F.when(opens, F.col("start")))])
    return (
        named.groupBy(*keys, "island").agg(F.max("end").alias("range_end"))
        .withColumnRenamed("island", "range_start")
    )


def page_runs(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive pages per key: ``run_start, run_end, n_pages``."""
    existing = pages.select(*keys, "page").where(F.col("page").isNotNull()).distinct()
    by_block = key_blocks(pages, keys, F.floor(F.col("page") / PAGE_BLOCK))
    # Along a run the page and its number grow alike, so their difference names the run.
    counted = running(existing, keys, [F.col("page")], by_block, [Running("nth", "count", F.lit(1))])
    runs = counted.groupBy(*keys, (F.col("page") - F.col("nth")).alias("_run")).agg(
        F.min("page").alias("run_start"), F.max("page").alias("run_end")
    )
    return runs.drop("_run").withColumn("n_pages", F.col("run_end") - F.col("run_start") + 1)


def page_label(page_refs: Column, dash: str = "–", max_chars: int | None = None) -> Column:
    """``[7, 2, 8, 3, 1]`` as ``1–3, 7–8``, for the bounded page list of one chunk."""
    pages = F.array_sort(F.array_distinct(page_refs))
    starts = F.filter(pages, lambda p, i: (i == 0) | (F.get(pages, i - 1) != p - 1))
    ends = F.filter(pages, lambda p, i: (i == F.size(pages) - 1) | (F.get(pages, i + 1) != p + 1))
    label = F.array_join(
        F.zip_with(
            starts, ends,
            lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit(dash), b.cast("string"))),
        ),
        ", ",
    )
    label = F.coalesce(label, F.lit(""))
    return label if max_chars is None else F.substring(label, 1, max_chars)
