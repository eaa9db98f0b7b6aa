"""The index on disk: append-only Parquet tables and a manifest for each version.

A run writes the rows of a version, points with their vectors, deletions, states of files and page
images, into folders of its own and commits them together with one manifest (``sources.manifests``).
Deletions are bits by file and row (``operators.positions``). Rows of a version are sorted by path.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.operators import cache, points, positions
from quillfin.sources import manifests
from quillfin.sources.manifests import Manifest

FORMAT = 2
# Page keys of about 100 bytes that are broadcast at most.
BROADCAST_PAGES = 200_000

POINT = (
    "segment_id string, path string, file_type string, modality string, page int, start_line int, end_line int, "
    "excerpt string, chunk_id string, file_sha256 string, kind string, title string, summary string, page_refs array<int>, "
    "line_ranges array<struct<start:int,end:int>>, char_ranges array<struct<start:int,end:int>>, order_key int, hero_page int, "
    "vectors array<array<float>>, version bigint"
)
STATE = (
    "path string, size bigint, mtime_ns bigint, content_hash_sha256 string, last_indexed_at double, point_ids array<string>, "
    "n_points int, version bigint"
)
PAGE = "sha string, page int, image binary, bytes bigint, version bigint"


class Index:
    def __init__(self, spark: SparkSession, root: str, dim: int) -> None:
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim
        self.reload()

    def reload(self) -> None:
        """Look at what is committed now."""
        self._manifests = manifests.committed(self.spark, self.root)
        self.version = self._manifests[-1].version if self._manifests else 0
        for m in self._manifests:
            if m.format != FORMAT:
                raise RuntimeError(f"index format {m.format} is not {FORMAT}; build a new index")
            if m.dim != self.dim:
                raise RuntimeError(f"index holds vectors of {m.dim} dimensions, the embedder makes {self.dim}; build a new index")

    def _folders(self, name: str) -> list[str]:
        return [f"{self.root}/{f}" for m in self._manifests for f in m.tables.get(name, [])]

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._read(self._folders(name), schema)

    def _positioned(self) -> DataFrame | None:
        """All committed point rows, dead ones too, with their positions."""
        folders = self._folders("points")
        return positions.with_positions(self._read(folders, POINT)) if folders else None

    def points(self) -> DataFrame:
        """Live points: rows with vectors that no later version deleted."""
        held = self._positioned()
        if held is None:
            return self._read([], POINT)
        return positions.live(held.where("vectors IS NOT NULL"), self._committed("deletions", positions.DELETIONS))

    def state(self) -> DataFrame:
        """Newest recorded state of each file; files recorded as gone drop out."""
        return points.latest(self._committed("state", STATE), "path", "version").where("content_hash_sha256 IS NOT NULL")

    def page_images(self, wanted: DataFrame) -> DataFrame:
        """Stored page images ``sha, page, image`` of the wanted ``(sha, page)`` rows, each once."""
        keys = wanted.select("sha", "page").distinct()
        # The pages of some results: few enough to travel to the images, which then stay where they lie.
        few = keys.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
        found = self._committed("pages", PAGE).join(F.broadcast(keys) if few else keys, ["sha", "page"], "left_semi")
        return found.groupBy("sha", "page").agg(F.min_by("image", "version").alias("image"))

    def page_files(self, wanted: DataFrame) -> DataFrame:
        """Writes the wanted page images as files under ``page_files``, so that the paths in results can be
        opened, and gives ``sha, page`` of those there. A file is written once, under another name first; only
        images without a file are read. Only the pages of results come here, not all stored ones."""
        root = f"{self.root}/page_files"

        def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = pa_fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
            for batch in batches:
                found = store.get_file_info([f"{base}/{w}" for w in batch.column("where").to_pylist()])
                there = pa.array([f.type == pa_fs.FileType.File for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("page"), there], ["sha", "page", "there"])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = pa_fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
            for batch in batches:
                for where, image in zip(batch.column("where").to_pylist(), batch.column("image")):
                    file = f"{base}/{where}"
                    store.create_dir(file.rpartition("/")[0], recursive=True)
                    draft = f"{file}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(draft) as out:
                        out.write(image.as_buffer())
                    store.move(draft, file)
                yield batch.select(["sha", "page"])

        where = cache.page_path(F.col("sha"), F.col("page")).alias("where")
        looked = wanted.select("sha", "page").distinct().select("sha", "page", where).mapInArrow(missing, "sha string, page int, there boolean").checkpoint()
        images = self.page_images(looked.where("NOT there")).select("sha", "page", where, "image")
        made = images.mapInArrow(write, "sha string, page int").checkpoint()
        return looked.where("there").select("sha", "page").unionAll(made)

    def evict_pages(self, target: str, max_bytes: int) -> DataFrame:
        """Write the page images that fit in ``max_bytes``, newest versions first, to another folder."""
        held = self._committed("pages", PAGE).dropDuplicates(["sha", "page"])
        sizes = held.select("sha", "page", "bytes", "version")
        marked = cache.lru_evictions(sizes, ["version", "sha", "page"], F.col("version"), max_bytes)
        kept = held.join(marked.where("NOT evict").select("sha", "page"), ["sha", "page"], "left_semi")
        kept.write.mode("append").parquet(target)
        return marked.where("evict").select("sha", "page", "bytes")

    def begin(self) -> Run:
        """A run that writes the next version."""
        return Run(self)

    def points_count(self) -> DataFrame:
        return self.points().agg(F.count("*").alias("points_count"))

    def compact(self) -> None:
        """Commit a version that holds only what is live and that readers start from. Files that no manifest
        from then on names can be deleted once no reader uses them."""
        run = self.begin()
        # Images count as long as a live point is of their file.
        files = self.points().select(F.col("file_sha256").alias("sha")).distinct()
        images = self._committed("pages", PAGE).join(files, "sha", "left_semi").dropDuplicates(["sha", "page"])
        for name, rows in (("points", self.points()), ("state", self.state()), ("pages", images)):
            run.append(name, rows)
        run.commit(base=True)


class Run:
    """Writes one version of an index: rows first, then the manifest that makes all of them count at once.

    A run that is not committed, or that loses against another (``manifests.Conflict``), leaves folders that
    nobody reads.
    """

    def __init__(self, index: Index) -> None:
        self.index, self.version, self._id = index, index.version + 1, uuid.uuid4().hex
        self._tables: dict[str, list[str]] = {}

    def _folder(self, name: str) -> str:
        return f"{name}/{self.version:012d}-{self._id}"

    def append(self, name: str, rows: DataFrame) -> None:
        order = next((c for c in ("path", "sha") if c in rows.columns), None)
        sorted_ = rows.sortWithinPartitions(order) if order else rows
        # Spark's committer renames files of finished tasks only, so a killed or doubled task leaves none.
        sorted_.write.mode("append").parquet(f"{self.index.root}/{self._folder(name)}")
        self._tables[name] = [self._folder(name)]

    def written(self, name: str, schema: str) -> DataFrame:
        """Rows that this run has appended."""
        return self.index._read([f"{self.index.root}/{f}" for f in self._tables.get(name, [])], schema)

    def delete(self, segment_ids: DataFrame) -> None:
        """Mark the committed points with these ids dead. Ids embed the file's content, so a re-ingest writes
        new ids or, of an unchanged file, the same ids in rows of its own, which stay alive."""
        held = self.index._positioned()
        if held is not None:
            self.append("deletions", positions.containers(positions.dead_positions(held, segment_ids, "segment_id")))

    def commit(self, base: bool = False) -> None:
        index = self.index
        held = index._manifests
        start = self.version if base or not held else held[-1].base
        made = Manifest(self.version, start, FORMAT, index.dim, time.time(), self._tables)
        manifests.commit(index.spark, index.root, made)
        index._manifests = [made] if base else [*held, made]
        index.version = self.version
