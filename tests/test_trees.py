"""Directory trees and split text files against plain Python."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillfin.settings import Settings
from quillfin.sources import splits, tree


@pytest.fixture
def folders(tmp_path):
    for i in range(60):
        d = tmp_path / "r" / f"a{i % 4}" / f"b{i % 3}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"f{i}.txt").write_text("x" * i)
    (tmp_path / "r" / ".git").mkdir()
    (tmp_path / "r" / ".git" / "x").write_text("")
    (tmp_path / "away").mkdir()
    (tmp_path / "away" / "far.txt").write_text("far")
    os.symlink(tmp_path / "away", tmp_path / "r" / "a0" / "link")
    os.symlink(tmp_path / "r", tmp_path / "r" / "a1" / "loop")
    return tmp_path / "r"


@pytest.mark.parametrize("partitions,wide", [(1, 20_000), (6, 20_000), (64, 20_000), (3, 2)])
def test_slices_cover_each_entry_once(folders, monkeypatch, partitions, wide):
    monkeypatch.setattr(tree, "WIDE", wide)
    rules = tree.Rules()
    rows = [row for s in tree.slices([str(folders)], rules, partitions) for row in tree.below(s.directory, rules, s)]
    files = sorted(r[0] for r in rows if r[1] == "file")
    assert files == sorted(str(p) for p in folders.rglob("f*.txt"))
    assert sorted(r[0] for r in rows if r[1] == "link") == sorted([str(folders), str(folders.parent / "away")])


def test_path_filters_reach_the_source(spark, folders):
    every = tree.tree(spark, [str(folders)], Settings())
    some = every.where(F.col("path").startswith(str(folders / "a2"))).where("kind = 'file'")
    assert sorted(r["path"] for r in some.collect()) == sorted(str(p) for p in (folders / "a2").rglob("f*.txt"))
    rules = tree.Rules(prefixes=(str(folders / "a2" / "b1" / "f"),))
    opened = {s.directory for s in tree.slices([str(folders)], rules)}
    assert opened == {str(folders), str(folders / "a2"), str(folders / "a2" / "b1")}
    assert every.where("kind = 'file'").agg(F.sum("size")).first()[0] == sum(range(60))


def test_stream_of_a_tree_takes_each_file_once(spark, folders, tmp_path):
    old = 1_600_000_000
    for p in folders.rglob("f*.txt"):
        os.utime(p, (old, old))

    def run():
        q = tree.arriving(spark, [str(folders)], Settings()).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        assert query.awaitTermination(90)
        return [r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    assert len(run()) == 60
    (folders / "a3" / "late.txt").write_text("new")
    time.sleep(tree.SETTLED_NS / 1e9 + 0.2)
    found = run()
    assert len(found) == len(set(found)) == 61 and str(folders / "a3" / "late.txt") in found


PIECES = ["a", "é", "\U0001f600", "\n", "\n", "\r\n", "\r", "\r\r\n", "long line " * 9, b"\xff".decode("latin-1"), ""]


@pytest.mark.parametrize("split", [1, 3, 7, 64, 1 << 20])
def test_splits_give_the_lines_of_the_whole_text(spark, tmp_path, split):
    r = random.Random(split)
    wanted, rows = {}, []
    for i in range(30 if split > 3 else 8):
        raw = "".join(r.choice(PIECES) for _ in range(r.randrange(40))).encode()
        if i % 4 == 0:
            raw = raw.replace(b"\xc3", b"")  # faulty UTF-8
        path = tmp_path / f"{i}.txt"
        path.write_bytes(raw)
        rows.append((str(path), len(raw)))
        wanted[str(path)] = raw.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    rows.append((str(tmp_path / "none"), 5))
    got: dict = {}
    for line in splits.text_lines(spark.createDataFrame(rows, "path string, size long"), split).collect():
        got.setdefault(line["path"], []).append((line["line_no"], line["char_start"], line["char_end"], line["text"]))
    assert set(got) == set(wanted)
    for path, text in wanted.items():
        at, want = 0, []
        for n, piece in enumerate(text.split("\n"), 1):
            want.append((n, at, at + len(piece), piece))
            at += len(piece) + 1
        assert sorted(got[path]) == want
