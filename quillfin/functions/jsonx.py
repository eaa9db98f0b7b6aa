"""JSON found in model replies: locate the block, repair truncation, validate topics."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.functions.text import strip, unfenced


def json_block(reply: Column, opener: str = "{") -> Column:
    """Outermost object (or array) text of a reply, null if there is none."""
    pattern = r"(?s)\{.*\}" if opener == "{" else r"(?s)\[.*\]"
    return F.nullif(F.regexp_extract(unfenced(reply), pattern, 0), F.lit(""))


# Complete strings and structure; a quotation mark on its own opens a string that never ends.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],"]', re.S)
_CLOSER = {"{": "}", "[": "]"}


def resume_points(blob: str) -> Iterator[tuple[int, str]]:
    """Places where a cut text can end, in order, each with what closes the scopes still open there.

    These are the commas inside a scope, and the end of the outermost scope.
    """
    scopes = ""
    for token in _TOKEN.finditer(blob):
        sign = token[0]
        if sign == '"':
            return
        if sign in _CLOSER:
            scopes = _CLOSER[sign] + scopes
        elif sign == "," and scopes:
            yield token.start(), scopes
        elif sign in ("}", "]"):
            scopes = scopes[1:]
            if not scopes:
                yield token.end(), ""


def loads(text: str):
    """The parsed value in a list, or an empty list."""
    try:
        return [json.loads(text)]
    except (ValueError, RecursionError):
        return []


def repaired(blob: str | None) -> str | None:
    """The JSON text itself if valid, else its longest prefix that is valid once closed, else null."""
    if blob is None or loads(blob):
        return blob
    for end, closers in reversed(list(resume_points(blob))):
        text = blob[:end].rstrip().rstrip(",") + closers
        if loads(text):
            return text
    return None


@F.arrow_udf(T.StringType())
def repair_json(blobs: pa.Array) -> pa.Array:
    return pa.array([repaired(b) for b in blobs.to_pylist()], pa.string())


def strict(text: Column) -> Column:
    """One JSON value and nothing after it, as a variant; else null."""
    # The parser stops behind the first value, so the text is made the only item of an array.
    only = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(only) == 1, F.get(only, F.lit(0)))


def read(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds ``out``: the value of a JSON text, as a variant; damaged text is repaired, hopeless text null.

    Only damaged texts are worked on in Python.
    """
    parsed = df.withColumn("_text", text).withColumn(out, strict(F.col("_text")))
    damaged = F.when(F.col(out).isNull(), F.col("_text"))
    return parsed.withColumn("_fixed", repair_json(damaged)).withColumn(out, F.coalesce(out, F.try_parse_json("_fixed"))).drop("_text", "_fixed")


# ---- typed access to one value, which may be of any kind -------------------------------------------


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def items(value: Column) -> Column:
    """The items of an array, none for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def kind(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return kind(value) == "OBJECT"


def own_string(value: Column) -> Column:
    """A string, null for anything else."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def own_int(value: Column) -> Column:
    """A number written without decimals, null for anything else."""
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "int"))


def label(value: Column) -> Column:
    """A scalar as stripped text; empty for what is missing, zero, false or no scalar."""
    scalar = F.when(kind(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"), F.try_variant_get(value, "$", "string"))
    plain = (kind(value) != "STRING") & (scalar.isin("0", "false") | (scalar.try_cast("double") == 0))
    return strip(F.when(F.coalesce(plain, F.lit(False)), "").otherwise(F.coalesce(scalar, F.lit(""))))


def whole_number(value: Column) -> Column:
    """An integer from a number (decimals cut off), a boolean, or a string of digits; else null."""
    digits = own_string(value)
    return (
        F.when(kind(value) == "STRING", F.when(digits.rlike(r"^\s*[+-]?[0-9]+\s*$"), strip(digits).try_cast("int")))
        .when(kind(value).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "double").try_cast("int"))
        .when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
    )


def number(value: Column) -> Column:
    """A double from a number, a boolean or a numeric string; else null."""
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(
        kind(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "string").try_cast("double")
    )


def truth(value: Column) -> Column:
    """Whether a value is there and neither false, zero, empty nor null."""
    k = kind(value)
    return F.coalesce(
        F.when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(k.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "double") != 0)
        .when(k == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(k == "VOID", False)
        .otherwise(~F.try_variant_get(value, "$", "string").isin("[]", "{}")),
        F.lit(False),
    )


def parse_page_topics(replies: DataFrame, max_topics: int = 16) -> DataFrame:
    """Page-topic assignments ``path, window_no, page, ord, topic_id, is_continuation, title, summary``.

    ``replies``: ``path, window_no, pages array<int>, reply``. Both reply forms are read: pages with
    topics, and for a one-page window the short form with topics only. Each entry is judged by itself: it
    needs a page of the window (a number) and an id (a string that is not empty); what fails is left out
    and the rest stays. Of the new titles of a window only the first ``max_topics`` distinct survive.
    ``models.topics.page_topics`` is the same for one reply in Python.
    """
    parsed = read(replies, json_block(F.col("reply")), "_d")
    short = (F.size("pages") == 1) & (kind(member(F.col("_d"), "pages")) != "ARRAY")
    of_pages = F.transform(
        F.filter(items(member(F.col("_d"), "pages")), is_object),
        lambda e: F.struct(own_int(member(e, "page")).alias("page"), items(member(e, "topics")).alias("topics")),
    )
    alone = F.array(F.struct(F.get("pages", F.lit(0)).alias("page"), items(member(F.col("_d"), "topics")).alias("topics")))
    t = F.col("_t")

    def either(long: str, brief: str) -> Column:
        return F.coalesce(member(t, long), member(t, brief))

    rows = (
        parsed.select("path", "window_no", "pages", F.posexplode(F.when(short, alone).otherwise(of_pages)).alias("_pi", "_p"))
        .where(F.array_contains("pages", F.col("_p.page")))
        .select("path", "window_no", F.col("_p.page").alias("page"), "_pi", F.posexplode("_p.topics").alias("_ti", "_t"))
        .where(is_object(t) & (F.coalesce(own_string(member(t, "id")), F.lit("")) != ""))
        .select(
            "path", "window_no", "page",
            F.struct("_pi", "_ti").alias("_at"),
            F.col("_ti").alias("ord"),
            own_string(member(t, "id")).alias("topic_id"),
            truth(either("is_continuation", "c")).alias("is_continuation"),
            label(either("title", "t")).alias("title"),
            label(either("summary", "s")).alias("summary"),
        )
    )
    fresh = ~F.col("is_continuation") & (F.col("title") != "")
    # A window is one bounded reply, so windows over (path, window_no) stay small.
    reply_scope = Window.partitionBy("path", "window_no")
    first_seen = F.min(F.when(fresh, F.col("_at"))).over(Window.partitionBy("path", "window_no", "title"))
    capped = (
        rows.withColumn("_first", first_seen)
        .withColumn("_new_no", F.dense_rank().over(reply_scope.orderBy(F.asc_nulls_last("_first"))))
        .where(~fresh | (F.col("_new_no") <= max_topics))
    )
    return capped.drop("_first", "_new_no", "_at")


def parse_text_topics(replies: DataFrame) -> DataFrame:
    """Text topics ``path, window_no, ord, title, summary, ranges``.

    ``replies``: ``path, window_no, n_lines, line_offset, reply``. Each entry is judged by itself: it
    needs a title and a valid range, two integers with 1 <= start <= end, clamped to the window's lines
    and shifted by its offset.
    """
    parsed = read(replies, json_block(F.col("reply"), "["), "_d")
    pairs = F.transform(
        F.filter(F.transform(items(member(F.col("_t"), "ranges")), items), lambda r: F.size(r) == 2),
        lambda r: F.struct(whole_number(F.get(r, F.lit(0))).alias("start"), whole_number(F.get(r, F.lit(1))).alias("end")),
    )
    valid = F.filter(pairs, lambda r: (r["start"] >= 1) & (r["end"] >= r["start"]))
    shifted = F.transform(
        valid,
        lambda r: F.struct(
            (F.least(r["start"], F.col("n_lines")) + F.col("line_offset")).cast("int").alias("start"),
            (F.least(r["end"], F.col("n_lines")) + F.col("line_offset")).cast("int").alias("end"),
        ),
    )
    return (
        parsed.select("path", "window_no", "n_lines", "line_offset", F.posexplode(items(F.col("_d"))).alias("ord", "_t"))
        .where(is_object(F.col("_t")))
        .withColumn("ranges", shifted)
        .withColumn("title", label(member(F.col("_t"), "title")))
        .where((F.col("title") != "") & (F.size("ranges") > 0))
        .select("path", "window_no", "ord", "title", label(member(F.col("_t"), "summary")).alias("summary"), "ranges")
    )
