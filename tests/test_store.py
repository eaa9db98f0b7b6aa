"""Commits of the index and deletions by position."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillfin.models.embed import HashEmbedder
from quillfin.operators import maxsim, positions
from quillfin.plans import ingest as plans
from quillfin.settings import Settings
from quillfin.showcase.store import _filled
from quillfin.sources.index import POINT, Index
from quillfin.sources.manifests import Conflict, committed, put_if_absent


def some_points(spark, ids, version):
    rows = spark.createDataFrame([(str(i), f"/d/{i % 7}", [[float(i), 1.0]]) for i in ids], "segment_id string, path string, vectors array<array<float>>")
    return _filled(rows.withColumn("version", F.lit(version)), POINT)


def ids(index):
    return {r["segment_id"] for r in index.points().select("segment_id").collect()}


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "index")
    a, b = Index(spark, root, 2).begin(), Index(spark, root, 2).begin()
    a.append("points", some_points(spark, range(5), 1))
    b.append("points", some_points(spark, range(5, 9), 1))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    index = Index(spark, root, 2)
    assert ids(index) == {"0", "1", "2", "3", "4"} and index.version == 1
    again = index.begin()
    again.append("points", some_points(spark, range(5, 9), 2))
    again.commit()
    assert len(ids(Index(spark, root, 2))) == 9


def test_put_if_absent_has_one_winner_among_threads(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, path, str(i)), range(16)))
    assert sum(won) == 1 and open(path).read() == str(won.index(True))
    assert os.listdir(tmp_path / "m") == ["1.json"]


def test_put_if_absent_where_files_are_renamed(spark, tmp_path):
    """A file system of another scheme, over the same folder."""
    conf = spark._jsparkSession.sessionState().conf()
    conf.setConfString("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    path = "viewfs://shelf/in/m/1.json"
    assert put_if_absent(spark, path, "first") and not put_if_absent(spark, path, "second")
    assert (tmp_path / "m" / "1.json").read_text() == "first"
    assert [n for n in os.listdir(tmp_path / "m") if not n.endswith(".crc")] == ["1.json"]


def test_a_job_that_dies_leaves_nothing_visible(spark, tmp_path):
    root = str(tmp_path / "index")
    index = Index(spark, root, 2)
    first = index.begin()
    first.append("points", some_points(spark, range(5), 1))
    first.commit()
    broken = index.begin()
    dies = some_points(spark, range(100), 2).repartition(4).withColumn("title", F.when(F.col("segment_id") == "57", F.raise_error(F.lit("killed"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="killed"):
        broken.append("points", dies)
    assert ids(Index(spark, root, 2)) == {"0", "1", "2", "3", "4"}
    retried = index.begin()
    retried.append("points", some_points(spark, range(5, 7), 2))
    retried.delete(spark.createDataFrame([("1",), ("6",)], "segment_id string"))
    retried.commit()
    # A deletion is of rows that were committed before.
    assert ids(Index(spark, root, 2)) == {"0", "2", "3", "4", "5", "6"}


def test_ingest_after_a_lost_race_keeps_both(spark, tmp_path, monkeypatch):
    from quillfin.models.topics import OutlineModel

    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / "note.md").write_text(f"# Note {name}\ntext of {name}\n")
    embedder, root = HashEmbedder(), str(tmp_path / "index")
    models = plans.Models(embedder, OutlineModel())
    mine, other = Index(spark, root, embedder.dim), Index(spark, root, embedder.dim)
    real, raced = plans.state.superseded_points, []

    def late(*args):
        if not raced:
            raced.append(True)
            plans.ingest(other, [str(tmp_path / "b")], models, Settings())
        return real(*args)

    monkeypatch.setattr(plans.state, "superseded_points", late)
    done = plans.ingest(mine, [str(tmp_path / "a")], models, Settings())
    assert done.version == 2
    paths = {r["path"] for r in Index(spark, root, embedder.dim).points().select("path").collect()}
    assert paths == {str(tmp_path / n / "note.md") for n in "ab"}


def test_base_versions_bound_what_is_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), 2)
    for v in range(1, 4):
        run = index.begin()
        run.append("points", some_points(spark, [v], v))
        run.commit()
    index.compact()
    assert [m.version for m in committed(spark, index.root)] == [4] and ids(index) == {"1", "2", "3"}


@pytest.mark.parametrize("limit", [positions.BROADCAST_BYTES, 400])
def test_deletion_vectors_agree_with_an_anti_join(spark, tmp_path, limit):
    r = random.Random(2)
    n = 150_000
    spark.range(n).select("id", F.lit(1).alias("version")).repartition(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    scan = positions.with_positions(spark.read.parquet(str(tmp_path / "t")))
    dead = [{*range(40_000, 90_000), *r.sample(range(n), 300)}, {0, n - 1, *r.sample(range(n), 5000)}]
    vectors = [positions.containers(positions.dead_positions(scan, spark.createDataFrame([(i,) for i in d], "id long"), "id")) for d in dead]
    got = positions.live(scan, vectors[0].unionAll(vectors[1]), broadcast_bytes=limit)
    assert got.columns == ["id", "version"]
    assert sorted(r["id"] for r in got.collect()) == sorted(set(range(n)) - dead[0] - dead[1])
    assert positions.live(scan, vectors[0].where("false")).count() == n


def test_no_exchange_carries_vectors(spark, tmp_path):
    """400,000 tombstones: their bits travel, the vectors stay."""
    folder = str(tmp_path / "p")
    spark.range(800_000).select(
        F.col("id").cast("string").alias("segment_id"), F.array(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))).alias("vectors"), F.lit(1).cast("long").alias("version")
    ).write.parquet(folder)
    scan = positions.with_positions(spark.read.parquet(folder))
    dead = spark.range(0, 800_000, 2).select(F.col("id").cast("string").alias("segment_id"), F.lit(2).cast("long").alias("version"))
    kept = positions.live(scan, positions.containers(positions.dead_positions(scan, dead, "segment_id", "version")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    queries = spark.createDataFrame([("q", [[1.0, 0.0]])], "query_id string, vectors array<array<double>>")
    best = maxsim.maxsim_topk(kept, queries, 2).orderBy("rank").collect()
    assert [b["segment_id"] for b in best] == ["799999", "799997"]
