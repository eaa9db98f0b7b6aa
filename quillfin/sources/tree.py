"""Directory trees as a Python data source, ``spark.read.format("quillfin_tree")``.

Its partitions are directories, or slices of one that has many entries; each walks what is below it and
streams entries as the system gives them, so no listing is held and none passes through the driver but
the upper directories that the work is dealt by. Filters on ``path`` (equality and prefixes) are pushed
down and whole directories skipped. As a stream, offsets are modification times.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith

from quillfin.settings import CONFIG_NAMES, Settings

NAME = "quillfin_tree"
SCHEMA = "path string, kind string, reason string, size bigint, mtime_ns bigint"
# Partitions aimed at, and entries from which a directory is cut into slices.
PARTITIONS = 64
WIDE = 20_000
# A stream looks at files that were left alone for so long.
SETTLED_NS = 1_000_000_000


@dataclass(frozen=True)
class Rules:
    hidden: bool = False
    links: bool = True
    prefixes: tuple[str, ...] = ()

    def may_hold(self, directory: str) -> bool:
        """Whether paths with all prefixes can be below the directory."""
        below = directory.rstrip("/") + "/"
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def wants(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes)


@dataclass
class Slice(InputPartition):
    """A directory with all below it, or of a wide directory the entries whose name falls to ``nth`` of ``of``."""

    directory: str
    deep: bool = True
    nth: int = 0
    of: int = 1
    since: int | None = None
    until: int | None = None

    def has(self, name: str) -> bool:
        return self.of == 1 or zlib.crc32(os.fsencode(name)) % self.of == self.nth


def entries(directory: str, rules: Rules, part: Slice | None = None) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for a directory's entries. A link to a directory is of kind ``link`` and names its
    target; hidden names and config files vanish silently."""
    try:
        with os.scandir(directory) as found:
            for entry in found:
                if (entry.name.startswith(".") and not rules.hidden) or (part and not part.has(entry.name)):
                    continue
                try:
                    linked = entry.is_symlink()
                    real = os.path.realpath(entry.path) if linked else entry.path
                    if os.path.isdir(real):
                        if not linked:
                            yield real, "dir", None, None, None
                        elif rules.links:
                            yield real, "link", None, None, None
                    elif entry.name in CONFIG_NAMES:
                        continue
                    elif linked and not rules.links:
                        yield real, "skip", "symlink", None, None
                    else:
                        stat = os.stat(real)
                        yield real, "file", None, stat.st_size, stat.st_mtime_ns
                except OSError:
                    # It is there but can't be looked at; who reads it will say why.
                    yield entry.path, "file", None, None, None
    except OSError as exc:
        yield directory, "skip", f"walk error: {exc}", None, None


def below(directory: str, rules: Rules, part: Slice | None = None) -> Iterator[tuple]:
    """``entries`` of the directory and all directories below it, which are walked, not returned. Open listings are
    held, one for each level of depth."""
    open_listings = [entries(directory, rules, part)]
    while open_listings:
        row = next(open_listings[-1], None)
        if row is None:
            open_listings.pop()
        elif row[1] != "dir":
            if row[1] != "file" or rules.wants(row[0]):
                yield row
        elif (part is None or part.deep) and rules.may_hold(row[0]):
            open_listings.append(entries(row[0], rules))


def slices(roots: list[str], rules: Rules, aim: int = PARTITIONS) -> list[Slice]:
    """Roots opened from the top until there are enough directories to deal out. An opened directory stays as a
    slice of its own entries; of each at most ``WIDE`` are looked at."""
    waiting, made = deque(r for r in roots if rules.may_hold(r)), []
    while waiting and len(waiting) + len(made) < aim:
        directory, seen, inner = waiting.popleft(), 0, []
        for path, kind, *_ in entries(directory, rules):
            seen += 1
            if kind == "dir" and rules.may_hold(path):
                inner.append(path)
            if seen >= WIDE:
                break
        if seen >= WIDE:
            # Too wide to open here: its slices walk what is below them.
            made += [Slice(directory, True, k, aim) for k in range(aim)]
        else:
            made.append(Slice(directory, False))
            waiting.extend(inner)
    return made + [Slice(d) for d in waiting]


@dataclass
class _Reader(DataSourceReader):
    roots: list[str]
    rules: Rules
    aim: int
    _pushed: list[str] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("path",) and isinstance(f.value, str):
                self._pushed.append(f.value)
            # Other rows than files are not judged here, so Spark looks again.
            yield f

    def partitions(self) -> list[Slice]:
        return slices(self.roots, self._rules(), self.aim)

    def _rules(self) -> Rules:
        return replace(self.rules, prefixes=tuple(self._pushed))

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from below(partition.directory, self._rules(), partition)


@dataclass
class _Stream(DataSourceStreamReader):
    roots: list[str]
    rules: Rules
    aim: int

    def initialOffset(self) -> dict:
        return {"mtime_ns": -1}

    def latestOffset(self) -> dict:
        return {"mtime_ns": time.time_ns() - SETTLED_NS}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        found = slices(self.roots, self.rules, self.aim)
        return [replace(s, since=start["mtime_ns"], until=end["mtime_ns"]) for s in found]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for row in below(partition.directory, self.rules, partition):
            if row[1] == "file" and row[4] is not None and partition.since < row[4] <= partition.until:
                yield row

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """Options: ``roots`` (a JSON list of directories), ``hidden``, ``links``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[list[str], Rules, int]:
        flag = lambda name, default: str(self.options.get(name, default)).lower() == "true"
        return json.loads(self.options["roots"]), Rules(flag("hidden", False), flag("links", True)), int(self.options.get("partitions", PARTITIONS))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._given())


def _options(roots: list[str], settings: Settings, partitions: int) -> dict[str, str]:
    return {"roots": json.dumps(roots), "hidden": str(settings.include_hidden), "links": str(settings.follow_symlinks), "partitions": str(partitions)}


def tree(spark: SparkSession, roots: list[str], settings: Settings, partitions: int = PARTITIONS) -> DataFrame:
    """Rows of ``SCHEMA`` for all entries below the roots but directories. Links to directories are named, not entered."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format(NAME).options(**_options(roots, settings, partitions)).load()


def arriving(spark: SparkSession, roots: list[str], settings: Settings, partitions: int = PARTITIONS) -> DataFrame:
    """A stream of the files below the roots by modification time. A file that is put there with an older time
    than the last batch looked at is not seen; links to directories are not entered."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format(NAME).options(**_options(roots, settings, partitions)).load()
