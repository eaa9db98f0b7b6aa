"""Text files as lines, read in splits that begin anywhere in a file.

A split owns the lines that begin in its bytes and reads on to the end of the last one. No byte of a
longer UTF-8 character is a line end, so characters are never cut, whatever the split. Splits number lines
and characters from zero; sums over the splits before them, a few for each file, give their places in the file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.session import checkpoint_dir

SPLIT_BYTES = 64 << 20
LINES = "path string, line_no bigint, char_start bigint, char_end bigint, text string"
_READ = 1 << 20
_BATCH_CHARS = 8 << 20


def _opened(path: str):
    store, inner = pa_fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return store.open_input_file(inner)


def _raw_lines(path: str, start: int, end: int) -> Iterator[tuple[bytes, bool, int]]:
    """Lines that begin in ``start..end``, without their line feed, whether they had one, and where the next begins."""
    with _opened(path) as f:
        at = start
        if start:
            # The line that runs into this split belongs to the one before.
            f.seek(start - 1)
            at = start - 1
            while block := f.read(_READ):
                cut = block.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(block)
            else:
                return
            f.seek(at)
        parts: list[bytes] = []
        while at < end or parts:
            block = f.read(_READ)
            if not block:
                if parts:
                    yield b"".join(parts), False, at
                return
            begin = 0
            while (cut := block.find(b"\n", begin)) >= 0:
                parts.append(block[begin:cut])
                line = b"".join(parts)
                parts = []
                at += len(line) + 1
                yield line, True, at
                begin = cut + 1
                if at >= end:
                    return
            parts.append(block[begin:])


def text_lines(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``LINES`` for files given as ``path, size``: lines from 1, half-open character ranges without the line end.

    Bytes are UTF-8, faulty ones replaced; CR LF and CR are line ends like LF, and count as one character. As
    in a split of the whole text at line ends, a text that ends in one has an empty last line, and an empty file
    one empty line. A line is one cell; a file is not, whatever its size. Files that can't be read have no lines.
    """
    checkpoint_dir(files.sparkSession)
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long"))
    dealt = files.select("path", F.col("size").cast("long").alias("size"), F.explode(begins).alias("begin")).repartition("path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, size, begin in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "begin")]):
                number = chars = 0
                try:
                    lines = _raw_lines(path, begin, min(begin + split_bytes, size))
                    rest = begin or size > 0
                    for raw, ended, rest in lines:
                        for piece in raw.removesuffix(b"\r").split(b"\r") if ended else raw.replace(b"\r", b"\n").split(b"\n"):
                            text = piece.decode("utf-8", errors="replace")
                            rows.append((path, begin, number, chars, text))
                            number, chars, held = number + 1, chars + len(text) + 1, held + len(text)
                        if held > _BATCH_CHARS or len(rows) > 50_000:
                            yield _frame(rows)
                            rows, held = [], 0
                        rest = not (ended and rest == size)
                    if not rest:
                        # What follows the last line end of the file is a line, too.
                        rows.append((path, begin, number, chars, ""))
                except OSError:
                    continue
        yield _frame(rows)

    local = dealt.mapInArrow(run, "path string, begin bigint, number bigint, chars bigint, text string").checkpoint()
    totals = local.groupBy("path", "begin").agg(F.count("*").alias("n"), F.sum(F.length("text") + 1).alias("c"))
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "path", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("chars_before")
    )
    start = F.col("chars") + F.col("chars_before")
    return local.join(offsets, ["path", "begin"]).select(
        "path", (F.col("number") + F.col("lines_before") + 1).alias("line_no"), start.alias("char_start"), (start + F.length("text")).alias("char_end"), "text"
    )


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["path", "begin", "number", "chars", "text"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
