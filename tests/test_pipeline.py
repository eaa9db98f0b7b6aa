"""Files on disk through ingest, search, rendering and streams, with small stand-in models."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin import settings as conf
from quillfin.models.embed import HashEmbedder
from quillfin.models.topics import OutlineModel
from quillfin.plans import evaluate
from quillfin.plans.ingest import Models, ingest
from quillfin.plans.search import search
from quillfin.sources import files as fs
from quillfin.sources.index import PAGE, Index
from quillfin.streaming.ingest import arrivals, keep_indexed
from quillfin.streaming.topics import closed_topics
from tests.test_operators import _fold, _random_assignments


class FormFeedReader:
    """Pages separated by form feeds; each page also has its bytes as its image."""

    def pages(self, content):
        for n, page in enumerate(content.decode().split("\f")[1:], 1):
            if "BROKEN" in page:
                raise RuntimeError("bad page")
            yield n, page, page.encode()


class PictureEmbedder(HashEmbedder):
    def __reduce__(self):
        return PictureEmbedder, (self.cache_words,)

    def embed_images(self, images):
        return self.embed_texts([i.decode() for i in images])


class Failing:
    def generate(self, prompt, images):
        raise RuntimeError("no model")


class Reversing:
    def generate(self, prompt, images):
        n = prompt.count("(pages ")
        return json.dumps([{"id": i, "rank": n - i, "score": 1, "reason": f"was {i}"} for i in range(n)])


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "gpio.md").write_text("# GPIO driver\nset the pin high with the output register\n")
    (root / "sub" / "_clock.c").write_bytes("/* Uhr für Ärger */\r\nconfigure the clock tree\r\n".encode())
    (root / ".hidden" / "secret.txt").write_text("hidden words")
    (root / "empty.txt").write_text("")
    (root / "blank.txt").write_text(" \n \n")
    (root / "firmware.elf").write_bytes(b"\x7fELF" + b"\x00" * 100)
    (root / "pic.png").write_bytes(b"\x89PNG\r\n\x1a\n rest")
    (root / "quillfin.json").write_text("{}")
    (root / "sheet.pdf").write_bytes(b"%PDF-1.7\fadc converter\fdac voltage\freference voltage")
    os.symlink(root / "gpio.md", root / "link.md")
    os.symlink(root, root / "sub" / "loop")
    return root


def _index(spark, tmp_path, embedder):
    return Index(spark, str(tmp_path / "index"), embedder.dim)


def _stats(done):
    return tuple(done.stats.first())


def test_walk_and_inspect(spark, corpus):
    files, skipped = fs.walk(spark, [str(corpus), str(corpus / "sub"), str(corpus / "nothing"), str(corpus / "quillfin.json")], conf.Settings())
    kinds = {os.path.basename(r["path"]): r["file_type"] for r in fs.inspect(files).collect()}
    assert kinds == {
        "gpio.md": "text", "_clock.c": "text", "empty.txt": None, "blank.txt": "text", "firmware.elf": None,
        "pic.png": "image", "sheet.pdf": "pdf",
    }
    reasons = {(os.path.basename(r["path"]), r["reason"]) for r in skipped.collect()}
    assert reasons == {("nothing", "not a file or directory"), ("quillfin.json", "config file")}
    _, strict = fs.walk(spark, [str(corpus)], conf.Settings(follow_symlinks=False))
    assert [r["reason"] for r in strict.collect()] == ["symlink"]


def test_binary_files_agree_with_inspect(spark, corpus):
    files, _ = fs.walk(spark, [str(corpus)], conf.Settings())
    mine = {r["path"]: (r["content_hash_sha256"], r["file_type"]) for r in fs.inspect(files).collect()}
    theirs = fs.binary_files(spark, [str(corpus)]).drop("content").collect()
    assert theirs and all(mine[r["path"]] == (r["content_hash_sha256"], r["file_type"]) for r in theirs if r["path"] in mine)


def test_ingest_update_purge_and_search(spark, corpus, tmp_path):
    embedder = PictureEmbedder()
    models = Models(embedder, OutlineModel(), FormFeedReader())
    index = _index(spark, tmp_path, embedder)
    settings = conf.Settings()
    first = ingest(index, [str(corpus)], models, settings)
    assert _stats(first) == (5, 0, 0)
    assert {r["reason"] for r in first.skipped.collect()} == {"unsupported file type"}
    points = {(os.path.basename(r["path"]), r["modality"], r["page"]) for r in index.points().collect()}
    assert points == {
        ("gpio.md", "text", None), ("_clock.c", "text", None), ("pic.png", "text", None),
        *[("sheet.pdf", m, p) for m in ("text", "image") for p in (1, 2, 3)],
    }
    assert _stats(ingest(index, [str(corpus)], models, settings)) == (0, 0, 5)

    (corpus / "gpio.md").write_text("# UART driver\nbaud rate divider\n")
    os.remove(corpus / "pic.png")
    reopened = _index(spark, tmp_path, embedder)
    assert _stats(ingest(reopened, [str(corpus)], models, settings)) == (0, 1, 3)
    names = {os.path.basename(r["path"]) for r in reopened.points().collect()}
    assert names == {"gpio.md", "_clock.c", "sheet.pdf"}
    assert _stats(ingest(reopened, [str(corpus)], models, settings, force=True)) == (1, 3, 0)
    assert reopened.points_count().first()[0] == 8
    refs = spark.createDataFrame([(r["sha"], r["page"]) for r in reopened._committed("pages", PAGE).collect()], "sha string, page int")
    images = lambda i: {(r["sha"], r["page"], bytes(r["image"])) for r in i.page_images(refs).collect()}
    before = images(reopened)
    reopened.compact()
    assert len(before) == 3 and images(reopened) == before
    assert len(reopened._manifests) == 1 and len(_index(spark, tmp_path, embedder)._manifests) == 1
    assert reopened.points_count().first()[0] == reopened._positioned().count() == 8

    queries = spark.createDataFrame([("q1", "baud rate"), ("q2", "dac voltage")], "query_id string, query string")
    answer = search(reopened, queries, [str(corpus)], models, settings, top_k=3)
    rows = answer.results.orderBy("query_id", "rank").collect()
    best = [r for r in rows if r["rank"] == 1]
    assert os.path.basename(best[0]["path"]) == "gpio.md" and best[0]["start_line"] == 1 and "baud" in best[0]["excerpt"]
    assert best[1]["page_refs"] == [2] and best[1]["context_pages"][0]["page"] == 2
    with open(best[1]["context_pages"][0]["page_image_path"], "rb") as f:
        assert f.read() == b"dac voltage"
    gone = reopened.evict_pages(str(tmp_path / "kept"), 20)
    assert 0 < spark.read.parquet(str(tmp_path / "kept")).agg(F.sum("bytes")).first()[0] <= 20 and gone.count() > 0
    # Both points of a page are one result, so three results are three chunks.
    assert len({r["chunk_id"] for r in rows if r["query_id"] == "q2"}) == 3
    assert "sub/" in best[0]["location"]["directory_listing"]
    for form in ("json", "compact-json", "markdown", "markdown-rich"):
        text = {r["query_id"]: r["response"] for r in answer.render(form).collect()}
        assert "gpio.md" in text["q1"]
    assert json.loads({r[0]: r[1] for r in answer.render("json").collect()}["q1"])["status"] == "complete"

    inside = search(reopened, queries, [str(corpus / "sub" / "_clock.c")], models, settings, cut_first=True)
    assert {os.path.basename(r["path"]) for r in inside.results.collect()} == {"_clock.c"}
    turned = search(reopened, queries, [str(corpus)], models, settings, top_k=2, reranker=Reversing())
    kept = search(reopened, queries, [str(corpus)], models, settings, top_k=2, reranker=Failing())
    order = lambda a: [(r["query_id"], r["rank"], r["chunk_id"]) for r in a.results.orderBy("query_id", "rank").collect()]
    plain = [(r["query_id"], r["rank"], r["chunk_id"]) for r in rows if r["rank"] <= 2]
    assert order(kept) == plain and order(turned) != plain
    assert {r["rerank_reason"] for r in turned.results.collect()} != {None}


def test_without_models_files_are_skipped(spark, corpus, tmp_path):
    embedder = HashEmbedder()
    index = _index(spark, tmp_path, embedder)
    done = ingest(index, [str(corpus)], Models(embedder), conf.Settings())
    reasons = {os.path.basename(r["path"]): r["reason"] for r in done.skipped.collect()}
    assert reasons["gpio.md"].startswith("plan error") and reasons["sheet.pdf"].startswith("plan error")
    assert _stats(done) == (1, 0, 0)
    failing = ingest(index, [str(corpus)], Models(embedder, Failing(), FormFeedReader()), conf.Settings(chunker_stride_pages=2))
    assert "gpio.md" in {os.path.basename(r["path"]) for r in failing.skipped.collect()}
    titles = {r["title"] for r in index.points().where("file_type = 'pdf'").collect()}
    assert titles == {"Unparsed window (pages 1–2)", "Unparsed window (pages 3–3)"}


def test_deadline(spark, corpus, tmp_path):
    embedder = HashEmbedder()
    index = _index(spark, tmp_path, embedder)
    done = ingest(index, [str(corpus)], Models(embedder, OutlineModel()), conf.Settings(indexing_timeout=0.0))
    late = {os.path.basename(r["path"]) for r in done.skipped.where("reason = 'indexing timeout'").collect()}
    # An image and a blank text need no model; only files that a model should have read are late, and are read next time.
    assert {"gpio.md", "_clock.c"} <= late and _stats(done) == (2, 0, 0)
    again = ingest(index, [str(corpus)], Models(embedder, OutlineModel()), conf.Settings())
    assert _stats(again) == (2, 0, 2)


class Picky(HashEmbedder):
    """Fails on a whole batch if one of its texts is bad."""

    def __reduce__(self):
        return Picky, (self.cache_words,)

    def embed_texts(self, texts):
        if any("kaboom" in t for t in texts):
            raise RuntimeError("bad text")
        return super().embed_texts(texts)


def test_one_bad_text_and_a_word_deep_inside(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "notes[").write_text("x")
    (root / ".gitignore").write_text("notes[\n")
    (root / "bad.md").write_text("# Bad\nkaboom\n")
    # One topic of one line, with a word that is nowhere else far behind its beginning.
    (root / "long.md").write_text("filler " * 9_000 + "quokka" + " filler" * 50)
    embedder = Picky()
    index = _index(spark, tmp_path, embedder)
    models = Models(embedder, OutlineModel())
    queries = spark.createDataFrame([("q", "quokka")], "query_id string, query string")
    answer = search(index, queries, [str(root)], models, conf.Settings(), top_k=500)
    top = answer.results.orderBy("rank").first()
    assert os.path.basename(top["path"]) == "long.md" and top["score"] > 0.99 and answer.status == "complete"
    reasons = {os.path.basename(r["path"]): r["reason"] for r in answer.ingested.skipped.collect()}
    assert reasons["bad.md"].startswith("embed error")
    assert "notes[" not in top["location"]["directory_listing"]


def test_search_answers_in_part(spark, corpus, tmp_path):
    class NoQueries(HashEmbedder):
        def __reduce__(self):
            return NoQueries, ()

        def embed_queries(self, texts):
            raise RuntimeError("no queries today")

    embedder = NoQueries()
    index = _index(spark, tmp_path, embedder)
    queries = spark.createDataFrame([("q", "pin")], "query_id string, query string")
    answer = search(index, queries, [str(corpus)], Models(embedder, OutlineModel()), conf.Settings())
    assert answer.status == "partial" and "no queries today" in " ".join(answer.errors) and answer.results.count() == 0
    (corpus / "new.md").write_text("fresh pin")
    index.begin = lambda: 1 / 0
    found = search(index, queries, [str(corpus / "gpio.md"), str(corpus / "new.md")], Models(HashEmbedder(), OutlineModel()), conf.Settings())
    assert found.status == "partial" and "Indexing error" in found.errors[0]
    assert {os.path.basename(r["path"]) for r in found.results.collect()} == {"gpio.md"}


class Seeing(PictureEmbedder):
    def __reduce__(self):
        return Seeing, (self.cache_words,)

    def embed_images(self, images):
        return self.embed_texts([i.split(b"\n")[-1].decode() for i in images])


class SeenReader(FormFeedReader):
    def ocr(self, image):
        return "zebra crossing" if b"rest" in image else ""


class Watching:
    """Ranks some questions backwards, and only if it is shown pages."""

    def generate(self, prompt, images):
        n = prompt.count("(pages ")
        if not images:
            raise RuntimeError("nothing to see")
        return json.dumps([{"id": i, "rank": n - i if "Question: dac voltage" in prompt else i + 1, "reason": f"{len(images)} pages"} for i in range(n)])


def test_images_are_documents_and_rerankers_see_pages(spark, corpus, tmp_path):
    embedder = Seeing()
    index = _index(spark, tmp_path, embedder)
    models = Models(embedder, OutlineModel(), SeenReader())
    queries = spark.createDataFrame([("a", "zebra"), ("b", "dac voltage")], "query_id string, query string")
    answer = search(index, queries, [str(corpus)], models, conf.Settings(), top_k=3, reranker=Watching())
    pictures = {r["modality"] for r in index.points().where("file_type = 'image'").collect()}
    assert pictures == {"text", "image"}
    rows = answer.results.collect()
    assert "pic.png" in {os.path.basename(r["path"]) for r in rows if r["query_id"] == "a"}
    assert {r["rerank_reason"] for r in rows if r["query_id"] == "b"} - {None}


def test_validation_queries(spark, tmp_path):
    file = tmp_path / "q.json"
    file.write_text(json.dumps({"queries": [{"id": "a", "query": "x", "paths": ["/p"], "expected_paths_contain": ["hit"]}]}))
    queries = evaluate.load_queries(spark, str(file))
    results = spark.createDataFrame([("a", "/some/hit.md")], "query_id string, path string")
    none = spark.createDataFrame([], "query_id string")
    assert tuple(evaluate.run_checks(results, none, queries).first())[1:] == (2, 2)
    file.write_text(json.dumps({"queries": [{"id": "a"}]}))
    with pytest.raises(ValueError):
        evaluate.load_queries(spark, str(file))


def test_diff_table(spark):
    a = spark.createDataFrame([("mrr", 0.5), ("semantic_at_5", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("mrr", 0.75), ("semantic_at_5", 0.5)], "metric string, value double")
    diff = evaluate.report_diff(a, b)
    assert [r["metric"] for r in diff.where("regression").collect()] == ["semantic_at_5"]
    lines = [r["line"] for r in evaluate.diff_table(diff).collect()]
    assert "| mrr | 0.500 | 0.750 | +0.250 ✓ |" in lines and "| semantic_at_5 | 1.000 | 0.500 | -0.500 ✗ |" in lines


def test_index_refuses_another_dimension(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), 4)
    index.begin().commit()
    with pytest.raises(RuntimeError):
        Index(spark, str(tmp_path / "index"), 8)


def test_settings(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "quillfin.json").write_text(json.dumps({"top_k": 7, "unknown": 1, "index_path": "idx"}))
    where, found = conf.find(str(tmp_path / "a" / "b"))
    assert where == str(tmp_path) and found.top_k == 7 and found.index_path == str(tmp_path / "idx")
    (tmp_path / "a" / conf.INDEX_DIR).mkdir()
    where, found = conf.find(str(tmp_path / "a" / "b"))
    assert where == str(tmp_path / "a") and found.top_k == 10
    (tmp_path / "a" / "quillfin.json").write_text("not json")
    assert conf.Root(str(tmp_path / "a")).settings() is None
    with pytest.raises(ValueError):
        conf.Settings(top_k=0)


def test_stream_of_files(spark, corpus, tmp_path):
    embedder = HashEmbedder()
    index = _index(spark, tmp_path, embedder)
    models = Models(embedder, OutlineModel())
    for expected in (2, 3):
        keep_indexed(index, arrivals(spark, str(corpus / "sub")), models, conf.Settings(), str(tmp_path / "ck")).awaitTermination()
        names = {os.path.basename(r["path"]) for r in index.points().collect()}
        assert len(names) == expected - 1 or len(names) == expected
        (corpus / "sub" / "late.txt").write_text("a late arrival")
    assert "late.txt" in names


@pytest.mark.parametrize("split", [1, 4])
def test_stream_of_pages_closes_the_same_topics(spark, tmp_path, split):
    rows = _random_assignments(11)
    ends = [(p, 10_000, 0, None) for p in "ab"]
    folder = str(tmp_path / "pages")
    ordered = sorted(rows + ends, key=lambda r: r[1])
    size = -(-len(ordered) // split)
    query = None
    for at in range(0, len(ordered), size):
        part = spark.createDataFrame(ordered[at : at + size], "path string, page int, ord int, topic_id string").withColumns(
            {"title": F.concat("topic_id", F.lit("@"), "page"), "summary": F.lit("")}
        )
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        query = (
            closed_topics(stream, 5, 4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = _fold(rows, 5, 4)
    # The end marker is a far page, so topics may close as cold first; the chunks are the same.
    assert {(r["path"], tuple(r["page_refs"]), r["title"]) for r in got} == want


def test_hash_vectors_are_unit_length():
    v = HashEmbedder().embed_texts(["Alpha beta alpha", ""])
    assert v[0].shape == (2, 32) and v[1].shape == (0, 32)
    assert np.allclose((v[0] ** 2).sum(axis=1), 1, atol=1e-6)
