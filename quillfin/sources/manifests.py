"""Versions of a folder of tables: one small file each, put in place at once or not at all.

Rows are written first, by Spark's own writer, into folders that no reader knows; a manifest then names
them. So a run that dies leaves nothing visible, and of two runs that write the same version one wins.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

_CONDITIONAL = "fs.option.create.conditional.overwrite"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass
class Manifest:
    """What a version adds. ``base`` is the version that readers start from: that one and later ones count."""

    version: int
    base: int
    format: int
    dim: int
    at: float
    tables: dict[str, list[str]] = field(default_factory=dict)


def _name(version: int) -> str:
    return f"{version:012d}.json"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return where, where.getFileSystem(conf), conf


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file, whole; it never changes one that is there, also if others try at the
    same time.

    Local files are linked in place. Stores that can create on condition, as object stores do, are asked to.
    Others must rename in one step and refuse to replace, as HDFS does.
    """
    where, fs, conf = _file_system(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme == "file":
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{local}.{uuid.uuid4()}.tmp"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    jvm, data = spark._jvm, text.encode()
    if fs.hasPathCapability(where, _CONDITIONAL):
        try:
            out = fs.createFile(where).overwrite(False).recursive().must(_CONDITIONAL, True).build()
            out.write(data)
            out.close()
        except Exception as exc:  # noqa: BLE001 - the store's refusals have many types
            if fs.exists(where):
                return False
            raise RuntimeError(f"no version could be written to {path}") from exc
        return True
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4()}.tmp")
    out = fs.create(draft, False)
    out.write(data)
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, where, none)
    except Exception as exc:  # noqa: BLE001
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(exc) or fs.exists(where):
            return False
        raise
    return True


def committed(spark: SparkSession, root: str) -> list[Manifest]:
    """Manifests from the newest one's base on, oldest first. One file name per version is listed; those since
    the base are read by one job."""
    where, fs, _ = _file_system(spark, f"{root}/manifests")
    if not fs.exists(where):
        return []
    names = sorted(n for s in fs.listStatus(where) if (n := s.getPath().getName()).endswith(".json"))
    if not names:
        return []

    def read(wanted: list[str]) -> list[Manifest]:
        rows = spark.read.text([f"{root}/manifests/{n}" for n in wanted], wholetext=True).collect()
        return sorted((Manifest(**json.loads(r[0])) for r in rows), key=lambda m: m.version)

    (newest,) = read(names[-1:])
    return read([n for n in names if n >= _name(newest.base)])


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    if not put_if_absent(spark, f"{root}/manifests/{_name(manifest.version)}", json.dumps(asdict(manifest))):
        raise Conflict(f"version {manifest.version} of {root} was committed by another writer")
