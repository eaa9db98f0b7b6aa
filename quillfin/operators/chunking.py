"""Splitting text into chunks, windows, ranges and excerpts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.functions.text import newlines, spans, token_estimate

_OUT_ROWS = 8192

CHUNK = (
    T.StructType()
    .add("chunk_no", T.IntegerType())
    .add("start_line", T.IntegerType())
    .add("end_line", T.IntegerType())
    .add("chunk_text", T.StringType())
)
RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def boundary_chunks(df: DataFrame, text_col: str, target: int = 900, overlap: int = 200) -> DataFrame:
    """One row per chunk: the other columns plus ``chunk_no, start_line, end_line, chunk_text``.

    Each cut depends on the one before it, so a text is walked in Python; texts are walked
    independently, in Arrow batches, where they lie.
    """
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in keep] + list(CHUNK.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            source: list[int] = []
            made: list[tuple[int, int, int, str]] = []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                line, seen = 1, 0
                for n, (a, b) in enumerate(spans(text, target, overlap)):
                    line += text.count("\n", seen, a)
                    seen = a
                    source.append(i)
                    made.append((n, line, line + text.count("\n", a, b), text[a:b]))
                    if len(made) >= _OUT_ROWS:
                        yield _emit(batch, keep, source, made)
                        source, made = [], []
            if made:
                yield _emit(batch, keep, source, made)

    return df.mapInArrow(run, schema)


def _emit(batch: pa.RecordBatch, keep: list[str], source: list[int], made: list[tuple]) -> pa.RecordBatch:
    at = pa.array(source, pa.int32())
    n, start, end, text = zip(*made)
    columns = [batch.column(c).take(at) for c in keep]
    columns += [pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text)]
    return pa.RecordBatch.from_arrays(columns, names=[*keep, "chunk_no", "start_line", "end_line", "chunk_text"])


def window_bounds(df: DataFrame, text_col: str, context_tokens: int) -> DataFrame:
    """Add ``n_lines`` and ``bounds``, the ``(first_line, last_line)`` of every window in order."""
    head = F.slice(F.split(F.col(text_col), "\n"), 1, 100)
    mean = F.floor(F.aggregate("_head", F.lit(0), lambda a, x: a + F.length(x)) / F.size("_head")).cast("int")
    fitting = F.floor(F.lit(context_tokens * 4) / F.greatest(F.lit(1), mean)).cast("int")
    sized = (
        df.withColumn("n_lines", newlines(F.col(text_col)) + 1)
        .withColumn("_head", head)
        .withColumn(
            "_len",
            F.when(token_estimate(F.col(text_col)) <= context_tokens, F.col("n_lines")).otherwise(F.greatest(F.lit(40), fitting)),
        )
        .withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_len") * 0.75).cast("int")))
    )
    # The last window is the first whose end reaches n_lines.
    last = F.greatest(F.lit(0), F.ceil((F.col("n_lines") - F.col("_len")) / F.col("_step")).cast("int"))
    bounds = F.transform(
        F.sequence(F.lit(0), last),
        lambda n: F.struct(
            (n * F.col("_step") + 1).alias("first_line"),
            F.least(F.col("n_lines"), n * F.col("_step") + F.col("_len")).alias("last_line"),
        ),
    )
    return sized.withColumn("bounds", bounds).drop("_head", "_len", "_step")


def line_windows(df: DataFrame, text_col: str, context_tokens: int = 8192) -> DataFrame:
    """Sliding line windows for texts over the model context: ``window_no, first_line, last_line``.

    Window length follows the mean line length of the first 100 lines; windows overlap by a quarter
    and stop with the first that reaches the last line. Texts within the context get one window.
    """
    keep = [c for c in df.columns if c != text_col]
    sized = window_bounds(df, text_col, context_tokens)
    return sized.select(*keep, "n_lines", F.posexplode("bounds").alias("window_no", "b")).select(*keep, "n_lines", "window_no", "b.*")


@F.arrow_udf(T.ArrayType(T.StringType()))
def cut_lines(texts: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """Texts of line ranges; the text is split once however many ranges it has."""
    out = []
    for text, a, b in zip(texts.to_pylist(), first.to_pylist(), last.to_pylist()):
        lines = text.split("\n")
        out.append(["\n".join(lines[i - 1 : j]) for i, j in zip(a, b)])
    return pa.array(out, pa.list_(pa.string()))


def window_texts(df: DataFrame, text_col: str, context_tokens: int = 8192) -> DataFrame:
    """``line_windows`` with ``window_text`` in place of the text, which is not repeated per window."""
    keep = [c for c in df.columns if c != text_col]
    sized = window_bounds(df, text_col, context_tokens)
    cut = sized.withColumn("texts", cut_lines(text_col, "bounds.first_line", "bounds.last_line"))
    zipped = F.arrays_zip("bounds", F.col("texts"))
    return cut.select(*keep, F.posexplode(zipped).alias("window_no", "w")).select(
        *keep, "window_no", "w.bounds.first_line", "w.bounds.last_line", F.col("w.texts").alias("window_text")
    )


def merge_ranges(ranges: Column) -> Column:
    """Merge overlapping and adjacent ``(start, end)`` ranges of one row; reversed ones are dropped."""
    valid = F.array_sort(F.filter(ranges, lambda r: r["start"] <= r["end"]))
    empty = F.array().cast(T.ArrayType(RANGE))

    # try_element_at keeps the first step (no range yet) free of an out-of-bounds error.
    def push(done: Column, r: Column) -> Column:
        tail = F.try_element_at(done, F.lit(-1))
        joined = F.struct(tail["start"].alias("start"), F.greatest(tail["end"], r["end"]).cast("int").alias("end"))
        fresh = F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))
        touches = F.coalesce(r["start"] <= tail["end"] + 1, F.lit(False))
        return F.when(
            touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(valid, empty, push)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def line_starts(texts: pa.Array) -> pa.Array:
    """Character offset of every line start (the first is 0)."""
    out = []
    for text in texts.to_pylist():
        if text is None:
            out.append(None)
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out.append(np.concatenate([[0], np.flatnonzero(points == 10) + 1]).astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def char_ranges(ranges: Column, starts: Column, n_chars: Column) -> Column:
    """Character ranges ``[start, end)`` of line ranges, given the line starts of the text."""
    total = F.size(starts)

    def one(r: Column) -> Column:
        first = F.least(F.greatest(r["start"], F.lit(1)), total)
        after = F.least(total, r["end"]) + 1
        return F.struct(
            F.element_at(starts, first).alias("start"),
            F.when(after <= total, F.element_at(starts, F.least(after, total))).otherwise(n_chars).cast("int").alias("end"),
        )

    return F.transform(ranges, one)


def text_slices(text: Column, ranges: Column) -> Column:
    return F.transform(ranges, lambda r: F.substr(text, r["start"] + 1, r["end"] - r["start"]))


def excerpt(lines: Column, ranges: Column, max_chars: int = 1800) -> Column:
    """Line-range blocks joined by a rule within a character budget; the block that overruns is cut."""
    start = F.struct(
        F.lit(max_chars).alias("budget"), F.array().cast("array<string>").alias("blocks")
    )

    def add(state: Column, r: Column) -> Column:
        first = F.greatest(F.lit(1), r["start"])
        count = F.greatest(F.lit(0), F.least(F.size(lines), r["end"]) - first + 1)
        block = F.array_join(F.slice(lines, first, count), "\n")
        fitted = F.when(
            F.length(block) > state["budget"], F.concat(F.substr(block, F.lit(1), state["budget"]), F.lit("..."))
        ).otherwise(block)
        return F.when(state["budget"] <= 0, state).otherwise(
            F.struct(
                (state["budget"] - F.length(fitted) - 4).alias("budget"),
                F.concat(state["blocks"], F.array(fitted)).alias("blocks"),
            )
        )

    return F.aggregate(ranges, start, add, lambda s: F.array_join(s["blocks"], "\n---\n"))
