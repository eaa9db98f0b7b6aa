"""Finding and reading files with Spark tasks.

``walk`` lists a POSIX tree that all executors can reach (a shared mount) through the data source of
``sources.tree``. It accounts for every skipped file. ``binary_files`` reads any Hadoop file system through Spark's own
source, which leaves out empty files and names that start with ``_`` or ``.``.
"""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.operators.state import fingerprints
from quillfin.session import checkpoint_dir
from quillfin.settings import CONFIG_NAMES, Settings
from quillfin.sources import tree
from quillfin.sources.content import IMAGE_MAGIC, PDF_MAGIC, file_type

_ENTRY = "path string, kind string, reason string"
INSPECTED = "path string, size bigint, mtime_ns bigint, content_hash_sha256 string, file_type string"
_BLOCK = 1 << 20
_ARROW_BYTES = 32 << 20


def binary_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Inspected files of any file system Spark reads: the columns of ``INSPECTED`` plus content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return fingerprints(files).select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        "content_hash_sha256",
        file_type(F.col("content")).alias("file_type"),
        "content",
    )


def walk(spark: SparkSession, paths: list[str], settings: Settings) -> tuple[DataFrame, DataFrame]:
    """``(files, skipped)``: distinct real paths to look at, and ``path, reason`` for the rest.

    One scan walks all requested directories (``sources.tree``). Links to directories are followed in rounds,
    each entering the targets that no round has walked.
    """
    checkpoint_dir(spark)
    requested = spark.createDataFrame([(p,) for p in paths], "path string").distinct()
    first = requested.mapInPandas(_resolver(), _ENTRY).checkpoint()
    # No more than were asked for.
    roots = sorted(r["path"] for r in first.where("kind = 'dir'").select("path").distinct().collect())
    outer = [r for i, r in enumerate(roots) if not any(_inside(r, o, settings) for o in roots[:i])]
    rounds = [first]
    if outer:
        rounds.append(tree.tree(spark, outer, settings).select("path", "kind", "reason").checkpoint())
    walked = spark.createDataFrame([(r,) for r in outer], "path string")
    while True:
        targets = rounds[-1].where("kind = 'link'").select("path").distinct()
        new = targets.where(~_under_any(F.col("path"), outer, settings)).join(walked, "path", "left_anti").checkpoint()
        if new.isEmpty():
            break
        rounds.append(new.repartition("path").mapInPandas(_walker(settings), _ENTRY).checkpoint())
        walked = walked.unionByName(new)
    found = reduce(DataFrame.unionByName, rounds)
    files = found.where("kind = 'file'").select("path").distinct()
    skipped = found.where("kind = 'skip'").select("path", "reason").distinct()
    return files, skipped


def _inside(path: str, root: str, settings: Settings) -> bool:
    """Whether a walk of ``root`` comes through ``path``."""
    if path == root:
        return True
    base = root.rstrip("/") + "/"
    return path.startswith(base) and (settings.include_hidden or "/." not in path[len(base) - 1 :])


def _under_any(path: Column, roots: list[str], settings: Settings) -> Column:
    """``_inside`` for any of the roots."""
    inside = F.lit(False)
    for root in roots:
        base = root.rstrip("/") + "/"
        seen = F.startswith(path, F.lit(base))
        if not settings.include_hidden:
            seen = seen & ~F.contains(F.substring(path, len(base), 1 << 20), F.lit("/."))
        inside = inside | (path == root) | seen
    return inside


def _resolver():
    """Explicitly requested paths: files, directories, or reasons to skip."""

    def one(path: str) -> tuple[str, str, str | None]:
        real = os.path.realpath(path)
        if os.path.isdir(real):
            return real, "dir", None
        if not os.path.isfile(real):
            return real, "skip", "not a file or directory"
        if os.path.basename(real) in CONFIG_NAMES:
            return real, "skip", "config file"
        return real, "file", None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(p) for p in frame["path"]], columns=["path", "kind", "reason"])

    return run


def _walker(settings: Settings):
    """All that is below directories, as it is found."""
    rules = tree.Rules(settings.include_hidden, settings.follow_symlinks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for directory in frame["path"]:
                rows = (row[:3] for row in tree.below(directory, rules))
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "kind", "reason"])

    return run


def inspect(files: DataFrame) -> DataFrame:
    """Size, time, hash and type of each file, read once in blocks and never held whole.

    A file that cannot be read has a null hash.
    """

    def one(path: str) -> tuple:
        digest, decoder = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
        head, textual = b"", True
        try:
            stat = os.stat(path)
            with open(path, "rb") as f:
                while block := f.read(_BLOCK):
                    digest.update(block)
                    head = head or block[:16]
                    if textual:
                        try:
                            decoder.decode(block)
                            textual = b"\x00" not in block
                        except UnicodeDecodeError:
                            textual = False
            if textual:
                try:
                    decoder.decode(b"", final=True)
                except UnicodeDecodeError:
                    textual = False
        except OSError:
            return path, None, None, None, None
        return path, stat.st_size, stat.st_mtime_ns, digest.hexdigest(), _kind(head, textual)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in INSPECTED.split(", ")]
        for frame in frames:
            rows = pd.DataFrame([one(p) for p in frame["path"]], columns=names)
            yield rows.astype({"size": "Int64", "mtime_ns": "Int64"})

    return files.select("path").mapInPandas(run, INSPECTED)


def _kind(head: bytes, textual: bool) -> str | None:
    if not head:
        return None
    start = head.hex().upper()
    if start.startswith(PDF_MAGIC):
        return "pdf"
    if start.startswith(IMAGE_MAGIC) or (head[:4] == b"RIFF" and head[8:12] == b"WEBP"):
        return "image"
    return "text" if textual else None


def with_content(files: DataFrame) -> DataFrame:
    """Add ``content binary`` to rows that have a ``path``; unreadable files get null."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            held: list[bytes | None] = []
            size = 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
                rows.append(i)
                size += len(held[-1] or b"")
                if size > _ARROW_BYTES:
                    yield _with(batch, rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield _with(batch, rows, held)

    def _with(batch: pa.RecordBatch, rows: list[int], held: list) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in names] + [pa.array(held, pa.binary())], names=[*names, "content"]
        )

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def directory_entries(directories: DataFrame, with_rules: bool = True) -> DataFrame:
    """``directory, name, rules``: entries (sub-directories end in a slash) and the ignore-file lines
    of the directory and everything above it."""

    def rules_of(directory: str) -> list[str]:
        lines: list[str] = []
        here = directory
        while True:
            try:
                with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    lines += f.read().splitlines()
            except OSError:
                pass
            above = os.path.dirname(here)
            if above == here:
                return lines
            here = above

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for directory in frame["directory"]:
                try:
                    with os.scandir(directory) as found:
                        names = [e.name + ("/" if e.is_dir(follow_symlinks=False) else "") for e in found]
                except OSError:
                    continue
                rules = rules_of(directory) if with_rules else []
                for at in range(0, len(names), 10_000):
                    part = names[at : at + 10_000]
                    yield pd.DataFrame({"directory": directory, "name": part, "rules": [rules] * len(part)})

    return directories.select("directory").mapInPandas(run, "directory string, name string, rules array<string>")
