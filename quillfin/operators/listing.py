"""Directory listings around a hit, and request-path expansion."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.functions.text import ancestors, basename, dirname, glob_regex
from quillfin.operators.skew import keyed_filter


def visible(relative_path: Column, include_hidden: bool = False) -> Column:
    """No part of the path below the searched directory starts with a dot."""
    return F.lit(True) if include_hidden else ~relative_path.rlike(r"(^|/)\.")


def under(path: Column, roots: list[str]) -> Column:
    """The path is one of the roots or lies below one: a plain predicate for one request's few roots."""
    tests = [(path == r) | F.startswith(path, F.lit(r + "/")) for r in (x.rstrip("/") for x in roots)]
    return reduce(or_, tests, F.lit(False))


def expand_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request, path) pairs where the path is the request itself or lies below it.

    Each path knows its own short list of ancestors, so the prefix test is an equi-join. A top
    directory is an ancestor of every path, hence the salted join.
    """
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("request"))
    wanted = requests.select(F.regexp_replace("request", r"(.)/+$", "$1").alias("request")).distinct()
    return keyed_filter(above, wanted, "request", "path").select("request", "path").distinct()


def ignored(name: Column, patterns: Column) -> Column:
    """Any of an array of ignore globs matches the whole name (a directory's slash left out)."""
    bare = F.regexp_replace(name, "/$", "")
    return F.exists(patterns, lambda p: F.rlike(bare, glob_regex(p)))


def ignore_patterns(lines: Column) -> Column:
    """Usable globs of an ignore file: no comments, negations or blanks, trailing slashes dropped."""
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(trimmed, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("!")))
    return F.transform(kept, lambda x: F.regexp_replace(x, "/+$", ""))


def directory_listings(entries: DataFrame, max_entries: int = 64) -> DataFrame:
    """``directory, listing, truncated, total`` from ``(directory, name)`` rows.

    Case-insensitive order; longer listings keep the first and last halves around a "...". Only the
    entries that can appear are gathered, and they are cut per partition before the shuffle.
    """
    half = max_entries // 2
    up = Window.partitionBy("directory").orderBy(F.lower("name"), "name")
    down = Window.partitionBy("directory").orderBy(F.lower("name").desc(), F.desc("name"))
    totals = entries.groupBy("directory").agg(F.count("*").alias("total"))
    # The first max_entries serve whole listings and the head of long ones alike.
    head = entries.withColumn("at", F.row_number().over(up)).where(F.col("at") <= max_entries)
    tail = entries.withColumn("at", F.row_number().over(down)).where(F.col("at") <= half)
    heads = _gather(head, "head")
    tails = _gather(tail, "tail")
    long = F.col("total") > max_entries
    return (
        totals.join(heads, "directory").join(tails, "directory", "left")
        .select(
            "directory",
            F.when(
                long,
                F.concat(F.slice("head", 1, half), F.array(F.lit("...")), F.reverse(F.coalesce("tail", F.array().cast("array<string>")))),
            ).otherwise(F.col("head")).alias("listing"),
            long.alias("truncated"),
            "total",
        )
    )


def _gather(rows: DataFrame, out: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("at", "name")))
    return rows.groupBy("directory").agg(F.transform(ordered, lambda s: s["name"]).alias(out))


def entries_of(files: DataFrame) -> DataFrame:
    """Listing entries implied by file paths: files by name, sub-directories with a trailing slash."""
    at = files.select("path", F.explode(ancestors(F.col("path"))).alias("node"))
    return at.select(
        dirname(F.col("node")).alias("directory"),
        F.when(F.col("node") == F.col("path"), basename(F.col("node")))
        .otherwise(F.concat(basename(F.col("node")), F.lit("/")))
        .alias("name"),
    ).distinct()
