"""Deadlines that end calls and jobs."""

import json
import os
import signal
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillfin.__main__ import embedder_of, main
from quillfin.models import limits
from quillfin.models.embed import HashEmbedder
from quillfin.models.topics import OutlineModel
from quillfin.plans.ingest import Models, ingest
from quillfin.plans.search import search
from quillfin.settings import Settings
from quillfin.sources.index import Index


def test_a_call_is_ended_where_it_stands():
    began = time.time()
    with pytest.raises(limits.Expired):
        limits.within(lambda: time.sleep(60), 0.2)
    assert time.time() - began < 5 and limits.within(lambda: 7, 5) == 7
    found = []

    def aside():
        try:
            limits.within(lambda: time.sleep(60), 0.2)
        except limits.Expired:
            found.append(limits.within(lambda: 8, 5))

    thread = threading.Thread(target=aside)
    thread.start()
    thread.join(10)
    assert found == [8]
    with pytest.raises(ZeroDivisionError):
        limits.within(lambda: 1 / 0, 5)


class Sleeping(OutlineModel):
    """Hangs on some prompts; deaf to alarms if asked."""

    def __init__(self, deaf: bool = False) -> None:
        super().__init__()
        self.deaf = deaf

    def generate(self, prompt, images):
        if "slow" in prompt:
            if self.deaf:
                signal.pthread_sigmask(signal.SIG_BLOCK, {signal.SIGALRM})
            time.sleep(3600)
        return super().generate(prompt, images)


@pytest.mark.parametrize("deaf", [False, True])
def test_a_model_that_hangs_makes_late_files(spark, tmp_path, monkeypatch, deaf):
    monkeypatch.setattr(limits, "GRACE", 3.0)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "fine.md").write_text("# Fine\nquick words\n")
    (tmp_path / "docs" / "slow.md").write_text("# slow\nslow words\n")
    embedder = HashEmbedder()
    queries = spark.createDataFrame([("q", "quick words")], "query_id string, query string")
    index = Index(spark, str(tmp_path / "index"), embedder.dim)
    began = time.time()
    answer = search(index, queries, [str(tmp_path / "docs")], Models(embedder, Sleeping(deaf)), Settings(indexing_timeout=12.0))
    assert time.time() - began < 120
    late = {os.path.basename(r["path"]) for r in answer.ingested.skipped.where("reason = 'indexing timeout'").collect()}
    # A file behind it in its task is late, too; a model that hears no alarm takes all files of its job with it.
    assert "slow.md" in late and (late == {"fine.md", "slow.md"} or not deaf)
    found = json.loads(answer.render("json").first()["response"])
    assert set(found["timing_ms"]) == {f"{s}_ms" for s in ("indexing", "query_embedding", "retrieval", "formatting", "rerank", "total")}
    assert found["skipped_count"] == len(late) == len(found["skipped"])
    assert sum(v for k, v in found["timing_ms"].items() if k != "total_ms") <= found["timing_ms"]["total_ms"] + 1
    both = answer.queries.unionAll(spark.createDataFrame([("r", "x")], answer.queries.schema))
    answer.queries = both
    many = json.loads(answer.render("json").where(F.col("query_id") == "q").first()["response"])
    assert many["skipped"] == [] and many["skipped_count"] == len(late)


def test_a_call_that_hangs_loses_only_its_file(spark, tmp_path):
    for name in ("slow", "fine", "good"):
        (tmp_path / f"{name}.md").write_text(f"# {name}\n{name} words\n")
    embedder = HashEmbedder()
    index = Index(spark, str(tmp_path / ".index"), embedder.dim)
    done = ingest(index, [str(tmp_path)], Models(embedder, Sleeping()), Settings(model_timeout=1.0))
    assert {os.path.basename(r["path"]): r["reason"] for r in done.skipped.collect()} == {"slow.md": "plan error: the topic model gave no usable topics"}


def test_command_line_flags(capsys):
    assert isinstance(embedder_of("quillfin.models.embed:HashEmbedder"), HashEmbedder)
    with pytest.raises(SystemExit) as done:
        main(["--version"])
    assert done.value.code == 0 and "quillfin 0." in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["x", "--log-level", "LOUD"])
