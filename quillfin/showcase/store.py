"""The index on disk over the test tables: versions, deletions, recorded states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.operators import positions
from quillfin.session import checkpoint_dir
from quillfin.showcase import Showcase, table
from quillfin.sources.index import POINT, STATE, Index

shown = Showcase()
add = shown.add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _filled(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with all columns of ``schema``, null where it has none."""
    shape = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def _embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("pt"), F.col("vec_id")).alias("segment_id"), F.concat(F.lit("/shelf/"), F.col("label")).alias("path"), F.array("embedding").alias("vectors"), "vec_id", "label"
    )


@add(
    """SELECT 'pt' || vec_id AS segment_id, '/shelf/' || label AS path, CAST(CASE WHEN label % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, len(embedding) AS dim
    FROM embeddings WHERE NOT (label % 3 = 1 AND vec_id % 2 = 0)"""
)
def index_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live points of an index after a load, a second version that writes a third of the paths again and
    deletes half of another third, and a run that was never committed."""
    index = Index(spark, scratch(spark, "index"), 64)
    rows = _embedding_points(spark, sf_dir)
    stored = lambda some, version: _filled(some.withColumn("version", F.lit(version)), POINT)
    first = index.begin()
    first.append("points", stored(rows, first.version))
    first.commit()
    second = index.begin()
    again = rows.where("label % 3 = 0")
    second.append("points", stored(again, second.version))
    second.delete(again.select("segment_id").unionAll(rows.where("label % 3 = 1 AND vec_id % 2 = 0").select("segment_id")))
    second.commit()
    index.begin().append("points", stored(rows, 3))
    return Index(spark, index.root, 64).points().select("segment_id", "path", "version", F.size(F.get("vectors", F.lit(0))).alias("dim"))


@add(
    """WITH seen AS (SELECT '/user/' || user_id AS path, CAST(epoch_ns(ts) AS BIGINT) AS mtime_ns, event_id,
      CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM events),
    newest AS (SELECT path, version, max(mtime_ns) AS mtime_ns, count(*) AS n_points FROM seen GROUP BY path, version)
    SELECT path, mtime_ns, CAST(n_points AS INTEGER) AS n_points, CAST(version AS BIGINT) AS version FROM newest n
    WHERE version = (SELECT max(version) FROM newest m WHERE m.path = n.path) AND NOT (version = 2 AND n_points % 5 = 0)"""
)
def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded state of each path after two versions, the second of which records some paths as gone."""
    index = Index(spark, scratch(spark, "index"), 64)
    seen = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/user/"), "user_id").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mtime_ns"), "event_id"
    )
    for version, some in ((1, seen.where("event_id % 4 <> 0")), (2, seen.where("event_id % 4 = 0"))):
        newest = some.groupBy("path").agg(F.max("mtime_ns").alias("mtime_ns"), F.count("*").cast("int").alias("n_points"))
        gone = (F.lit(version) == 2) & (F.col("n_points") % 5 == 0)
        run = index.begin()
        run.append("state", _filled(newest.withColumn("content_hash_sha256", F.when(~gone, F.sha2("path", 256))).withColumn("version", F.lit(version)), STATE))
        run.commit()
    return Index(spark, index.root, 64).state().select("path", "mtime_ns", "n_points", "version")


def stored_live(spark: SparkSession, pts: DataFrame, dead: DataFrame) -> DataFrame:
    """``pts`` written as files and read without the points that ``dead`` names, by their positions."""
    folder = scratch(spark, "points")
    pts.write.parquet(folder)
    scan = positions.with_positions(spark.read.parquet(folder))
    return positions.live(scan, positions.containers(positions.dead_positions(scan, dead, "segment_id", "version")))
