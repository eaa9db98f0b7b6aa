"""Operators against brute force on small random inputs, and edge cases the tables do not have."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.functions import jsonx
from quillfin.functions import text as tx
from quillfin.models.topics import OpenTopics, page_topics
from quillfin.operators import cache, chunking, listing, maxsim, points, rerank, running, skew, topics


# ---- text ---------------------------------------------------------------------------------------


def _plain_cut(text: str, begin: int, target: int) -> int:
    """The cut by the rule as worded, from all matches of each kind of break."""
    piece = text[begin : begin + target]
    for kind in tx.BREAKS:
        ends = [m.end() for m in re.finditer(kind, piece)]
        if ends:
            return begin + ends[-1]
    return begin + len(piece)


def _random_text(rng: random.Random) -> str:
    return "".join(rng.choices(["wall ", "tide. ", "\n", "\n\n", "\n## x ", "é" * 17, "! ", "?", " \n \n"], k=rng.randrange(80)))


def test_windows_end_behind_the_strongest_last_break():
    rng = random.Random(11)
    for _ in range(300):
        text, target, overlap = _random_text(rng), rng.randrange(1, 60), rng.randrange(0, 70)
        found = list(tx.spans(text, target, overlap))
        for begin, end in found:
            assert end == _plain_cut(text, begin, target) and begin < end <= begin + target
        for (b0, e0), (b1, _) in zip(found, found[1:]):
            assert b1 == (e0 - overlap if e0 - overlap > b0 else e0)
        assert (found[0][0], found[-1][1]) == (0, len(text)) if text else not found


def test_range_merging_and_slices_against_sets(spark):
    rng = random.Random(12)
    rows = [([(lo, lo + rng.randrange(-2, 9)) for lo in rng.choices(range(1, 40), k=rng.randrange(6))],) for _ in range(40)]
    df = spark.createDataFrame(rows, "r array<struct<start:int,end:int>>")
    for (given,), got in zip(rows, (r[0] for r in df.select(chunking.merge_ranges(F.col("r"))).collect())):
        covered = {i for a, b in given for i in range(a, b + 1)}
        # Touching ranges become one, so runs of covered numbers are the answer.
        heads = sorted(i for i in covered if i - 1 not in covered)
        assert [g["start"] for g in got] == heads
        assert {i for g in got for i in range(g["start"], g["end"] + 1)} == covered


def test_line_ranges_give_whole_lines(spark):
    rng = random.Random(13)
    lines = ["x" * rng.randrange(5) + "é\n" for _ in range(23)]
    ranges = [(a, a + rng.randrange(6)) for a in rng.choices(range(1, 30), k=12)]
    df = spark.createDataFrame([("".join(lines), ranges)], "t string, r array<struct<start:int,end:int>>")
    df = df.withColumn("s", chunking.line_starts("t"))
    slices = chunking.text_slices(F.col("t"), chunking.char_ranges(F.col("r"), F.col("s"), F.length("t")))
    assert df.select(slices).first()[0] == ["".join(lines[a - 1 : b]) for a, b in ranges]


def test_globs_match_as_the_shell_does(spark):
    import fnmatch

    rng = random.Random(14)
    bits = ["a", "b", "B", "*", "?", "[", "]", "!", "-", "^", "&&", ".", "\\", "[ab]", "[!a-c]", "[]x]", "{", "(", "+", "|", "é", "~"]
    patterns = ["notes[", "[!]a]", "[z-a]", "[&&b]", *("".join(rng.choices(bits, k=rng.randrange(1, 6))) for _ in range(150))]
    names = ["", "a", "b", "ab", "notes[", "]a", "x", "^", "&", "\\", "é", *("".join(rng.choices("abB[]!-^&.\\xé~", k=rng.randrange(1, 5))) for _ in range(60))]
    rows = [(p, n) for p in patterns for n in names]
    df = spark.createDataFrame(rows, "p string, n string").repartition(4)
    matched = df.withColumn("rx", tx.glob_regex(F.col("p"))).select("p", "n", F.expr("n rlike rx").alias("hit"))
    for r in matched.collect():
        assert r["hit"] == fnmatch.fnmatchcase(r["n"], r["p"]), r


def test_listing_leaves_out_ignored_names_and_the_middle(spark):
    names = [f"part-{i}.txt" for i in range(37)]
    df = spark.createDataFrame([(n,) for n in [*names, "tmp/", "x.bak", "notes["]], "name string").withColumn("directory", F.lit("/d"))
    rules = F.array(*[F.lit(x) for x in ("tmp/", "*.bak", "notes[", "# c", "!keep")])
    kept = df.where(~listing.ignored(F.col("name"), listing.ignore_patterns(rules)))
    row = listing.directory_listings(kept, 8).first()
    assert row["total"] == 37 and row["truncated"]
    assert row["listing"] == [*sorted(names)[:4], "...", *sorted(names)[-4:]]


def test_page_labels_against_runs(spark):
    rng = random.Random(15)
    rows = [(rng.choices(range(1, 20), k=rng.randrange(7)),) for _ in range(40)]
    df = spark.createDataFrame(rows, "p array<int>")
    for (pages,), got in zip(rows, (r[0] for r in df.select(topics.page_label(F.col("p"), "-", 100)).collect())):
        have = set(pages)
        runs = []
        for lo in sorted(p for p in have if p - 1 not in have):
            hi = next(p for p in range(lo, 40) if p + 1 not in have)
            runs.append(str(lo) if lo == hi else f"{lo}-{hi}")
        assert got == ", ".join(runs)


# ---- running aggregates and topics --------------------------------------------------------------


@pytest.mark.parametrize("block", ["blocks", "plain"])
def test_running_matches_loops_with_one_hot_key(spark, block):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(5), i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = running.running(
        df, ["k"], [F.col("o")], F.floor(F.col("o") / 16) if block == "blocks" else None,
        [
            running.Running("before", "sum", F.col("v"), before=True),
            running.Running("top", "max", F.col("v")),
            running.Running("low", "min", F.col("v"), before=True),
            running.Running("n", "count", F.lit(1)),
        ],
    ).collect()
    seen: dict = {}
    want = set()
    for k, o, v in rows:
        old = seen.setdefault(k, [])
        want.add((k, o, sum(old), max([*old, v]), min(old) if old else None, len(old) + 1))
        old.append(v)
    assert {(r["k"], r["o"], r["before"], r["top"], r["low"], r["n"]) for r in got} == want


def _fold(rows, cold, cap, stride=1):
    """Chunks of each file by walking its pages in order."""
    out = set()
    for path in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == path)
        pages = sorted({p for p, _, _ in mine})
        state = OpenTopics(cold, cap)
        for at in range(0, len(pages), stride):
            window = pages[at : at + stride]
            state.window([(p, t, f"{t}@{p}", "") for p, _, t in mine if p in window], window[-1])
        out |= {(path, tuple(sorted(pages_)), title) for _, (title, _, pages_, _) in state.finish()}
    return out


def _random_assignments(seed):
    rng = random.Random(seed)
    rows = set()
    for path in "ab":
        for page in sorted(rng.sample(range(1, 150), 90 if path == "a" else 30)):
            for t in rng.sample("xyzw", rng.randint(1, 2)):
                rows.add((path, page, t))
    return [(p, n, o, t) for o, (p, n, t) in enumerate(sorted(rows))]


@pytest.mark.parametrize("seed, cold, cap", [(1, 3, 4), (2, 1, 2), (3, 20, 15), (4, 6, 1)])
@pytest.mark.parametrize("hot", ["0", "1000000"])
def test_sessions_match_the_page_walk(spark, seed, cold, cap, hot):
    spark.conf.set(running.HOT_ROWS_SETTING, hot)
    rows = _random_assignments(seed)
    df = spark.createDataFrame(rows, "path string, page int, ord int, topic_id string").withColumns(
        {"title": F.concat("topic_id", F.lit("@"), "page"), "summary": F.lit(""), "is_continuation": F.lit(False)}
    )
    chunks = topics.topic_chunks(topics.topic_sessions(df, cold, cap, block=16)).collect()
    spark.conf.unset(running.HOT_ROWS_SETTING)
    assert {(r["path"], tuple(r["page_refs"]), r["title"]) for r in chunks} == _fold(rows, cold, cap)


def test_window_chunks_match_the_page_walk(spark):
    rows = _random_assignments(7)
    df = spark.createDataFrame(rows, "path string, page int, ord int, topic_id string").withColumns(
        {"title": F.concat("topic_id", F.lit("@"), "page"), "summary": F.lit("")}
    )
    windows = topics.page_windows(df, 3, block=16)
    newest = windows.groupBy("path", "window_no").agg(F.max("page").alias("newest"))
    placed = df.join(windows, ["path", "page"]).join(newest, ["path", "window_no"])
    got = topics.window_chunks(placed, 5, 4).collect()
    assert {(r["path"], tuple(r["page_refs"]), r["title"]) for r in got} == _fold(rows, 5, 4, stride=3)


def test_failed_windows_become_topics(spark):
    pages = spark.createDataFrame([("f", p) for p in range(1, 7)], "path string, page int")
    none = pages.where("page > 99")
    got = topics.unparsed_windows(pages, none, 3).select("title").distinct()
    assert {r[0] for r in got.collect()} == {"Unparsed window (pages 1–3)", "Unparsed window (pages 4–6)"}


def test_lru_keeps_the_newest(spark):
    entries = spark.createDataFrame([(i, 10) for i in range(20)], "mtime int, bytes int")
    got = cache.lru_evictions(entries, ["mtime"], F.floor(F.col("mtime") / 4), 35)
    assert sorted(r["mtime"] for r in got.where("NOT evict").collect()) == [17, 18, 19]
    one = cache.lru_evictions(entries, ["mtime"], F.floor(F.col("mtime") / 4), 10)
    assert [r["mtime"] for r in one.where("NOT evict").collect()] == [19]


# ---- scoring ------------------------------------------------------------------------------------


def _vectors(rng, n, dim=8):
    return rng.standard_normal((n, dim)).astype(np.float32).tolist()


def _points(spark, seed=42, n=50):
    rng = np.random.default_rng(seed)
    rows = [(f"p{i:03d}", f"c{i // 2}", _vectors(rng, 1 + i % 7)) for i in range(n)]
    rows += [("p900", "c0", rows[3][2]), ("p901", "", rows[3][2]), ("p902", None, [])]
    return rows, spark.createDataFrame(rows, "segment_id string, chunk_id string, vectors array<array<float>>")


def _queries(spark, n=6):
    rng = np.random.default_rng(7)
    rows = [(f"q{i}", _vectors(rng, 1 + i)) for i in range(n)]
    rows[-1][1].append(rows[-1][1][0])
    return rows, spark.createDataFrame(rows, "query_id string, vectors array<array<float>>")


def _brute(points_, queries_, k, grouped):
    out = set()
    for q, qv in queries_:
        scored = [
            (-round(float((np.array(qv, float) @ np.array(v, float).T).max(axis=1).sum()), 6), s, c or s)
            for s, c, v in points_ if v
        ]
        scored.sort()
        seen, rank = set(), 0
        for neg, s, c in scored:
            if grouped and c in seen:
                continue
            seen.add(c)
            rank += 1
            if rank <= k:
                out.add((q, rank, s, round(-neg, 5)))
    return out


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("limit", [maxsim.MAX_QUERY_BYTES, 400, 100])
def test_topk_is_brute_force_in_every_block_mode(spark, grouped, limit):
    prow, pdf = _points(spark)
    qrow, qdf = _queries(spark)
    got = maxsim.maxsim_topk(pdf.repartition(5), qdf, 7, group="chunk_id" if grouped else None, max_query_bytes=limit)
    assert {(r[0], r[1], r[2], round(r[3], 5)) for r in got.collect()} == _brute(prow, qrow, 7, grouped)


def test_topk_larger_than_the_corpus_and_empty_corpus(spark):
    prow, pdf = _points(spark, n=4)
    qrow, qdf = _queries(spark, 2)
    got = maxsim.maxsim_topk(pdf, qdf, 99)
    assert {(r[0], r[1], r[2], round(r[3], 5)) for r in got.collect()} == _brute(prow, qrow, 99, False)
    assert maxsim.maxsim_topk(pdf.where("false"), qdf, 5).count() == 0


@pytest.mark.parametrize("limit", [maxsim.MAX_QUERY_BYTES, 100])
def test_scores_of_documents_spread_over_tasks(spark, limit):
    prow, pdf = _points(spark)
    qrow, qdf = _queries(spark)
    tokens = pdf.select(F.coalesce("chunk_id", F.lit("none")).alias("doc_id"), F.explode("vectors").alias("v")).repartition(6)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in maxsim.maxsim_scores(tokens, qdf, limit).collect()}
    docs: dict = {}
    for _, c, v in prow:
        docs.setdefault("none" if c is None else c, []).extend(v)
    for q, qv in qrow:
        for d, v in docs.items():
            if v:
                want = (np.array(qv, float) @ np.array(v, float).T).max(axis=1).sum()
                assert got[q, d] == pytest.approx(want, abs=2e-6)


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i:02d}", (1 + 1e-7 * rng.standard_normal((2, 8))).tolist()) for i in range(40)]
    pdf = spark.createDataFrame(rows, "segment_id string, vectors array<array<double>>")
    qrow = [("q", (100 * rng.standard_normal((3, 8))).tolist())]
    qdf = spark.createDataFrame(qrow, "query_id string, vectors array<array<double>>")
    got = maxsim.maxsim_topk(pdf.repartition(3), qdf, 5).collect()
    want = _brute([(s, None, v) for s, v in rows], qrow, 5, False)
    assert {(r[0], r[1], r[2], round(r[3], 5)) for r in got} == want


def test_constant_vectors_tie_and_sort_by_id(spark):
    same = [[0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.2, 0.1]]
    pdf = spark.createDataFrame([(s, same) for s in "dbca"], "segment_id string, vectors array<array<float>>")
    qdf = spark.createDataFrame([("q", same)], "query_id string, vectors array<array<float>>")
    got = maxsim.maxsim_topk(pdf, qdf, 3).orderBy("rank").collect()
    assert [r["segment_id"] for r in got] == ["a", "b", "c"] and got[0]["score"] == pytest.approx(0.6, abs=1e-6)


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, 0])
def test_keyed_filter_with_a_hot_key(spark, limit):
    rows = [("hot" if i % 3 else f"k{i % 7}", str(i)) for i in range(300)]
    left = spark.createDataFrame(rows, "k string, id string")
    right = spark.createDataFrame([("hot",), ("k0",), ("k0",), (None,), ("other",)], "k string")
    for how, keep in (("left_semi", True), ("left_anti", False)):
        got = skew.keyed_filter(left, right, "k", "id", how, limit).select("k", "id").collect()
        assert sorted(tuple(r) for r in got) == sorted(r for r in rows if (r[0] in ("hot", "k0")) == keep)


def test_path_filter_edges(spark):
    df = spark.createDataFrame([("a",), ("b",)], "path string")
    assert points.in_paths(df, None).count() == 2
    assert points.in_paths(df, []).count() == 0
    assert points.in_paths(df, ["a"]).count() == 1


# ---- replies ------------------------------------------------------------------------------------


def test_repair():
    assert jsonx.repaired('[{"a": 1}, {"b": 2') == '[{"a": 1}]'
    assert jsonx.repaired('{"a": [1, 2, {"x": "y, z') == '{"a": [1, 2]}'
    assert jsonx.repaired('{"a": 1} trailing') == '{"a": 1}'
    assert jsonx.repaired("no json") is None
    assert jsonx.repaired(None) is None


def test_merge_ranks(spark):
    results = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate("abcdefgh")], "query_id string, rank int, title string")
    ranks = spark.createDataFrame(
        [("q", 0, 0, 3, 1.0, "third"), ("q", 1, 1, 2, 1.0, "second"), ("q", 2, 2, 1, 1.0, "first"), ("q", 3, 6, 1, 9.0, "outside"), ("q", 4, 0, 0, 9.0, "again")],
        "query_id string, ord int, id int, rank int, score double, reason string",
    )
    got = rerank.merge_ranks(results, ranks, 5).orderBy("rank").collect()
    assert "".join(r["title"] for r in got) == "cbadefgh"
    assert [r["rerank_reason"] for r in got][:4] == ["first", "second", "third", None]
    same = rerank.merge_ranks(results, ranks.where("false"), 5).orderBy("rank").collect()
    assert "".join(r["title"] for r in same) == "abcdefgh"


# ---- replies of any kind ------------------------------------------------------------------------


def _random_value(rng: random.Random, depth: int = 0):
    if depth < 3 and rng.random() < 0.35:
        return [_random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if depth < 3 and rng.random() < 0.5:
        keys = ["pages", "page", "topics", "id", "is_continuation", "c", "title", "t", "summary", "s", "ranges", "rank"]
        return {k: _random_value(rng, depth + 1) for k in rng.sample(keys, rng.randrange(5))}
    return rng.choice(["a", "b", "", " x ", "7", "1.5", 1, 2, 3, 0, True, False, None])


def _random_reply(rng: random.Random) -> str:
    topic = lambda: {"id": rng.choice(["t1", "t2", "", 5, None]), "title": rng.choice(["A", "B", " C ", "", 0]), rng.choice(["c", "is_continuation"]): rng.choice([0, 1, True, "", "no"])}
    page = lambda: {"page": rng.choice([1, 2, 3, "1", True]), "topics": [rng.choice([topic(), topic(), _random_value(rng)]) for _ in range(3)]}
    doc = rng.choice([{"pages": [rng.choice([page(), page(), _random_value(rng)]) for _ in range(3)]}, {"topics": [topic(), topic(), 7]}, _random_value(rng)])
    text = json.dumps(doc)
    cut = text[: rng.randrange(len(text) + 1)] if rng.random() < 0.3 else text
    return rng.choice(["", "Sure: ", "```json\n"]) + cut + rng.choice(["", " bye", "}", "\n```"])


def test_page_replies_are_read_alike_by_table_and_by_loop(spark):
    rng = random.Random(21)
    rows = [(str(i), 0, rng.choice([[1], [1, 2], [2, 3]]), rng.choice([_random_reply(rng), None]) if i % 40 == 0 else _random_reply(rng)) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, window_no int, pages array<int>, reply string").repartition(4)
    got: dict = {}
    for r in jsonx.parse_page_topics(df, 2).collect():
        got.setdefault(r["path"], []).append((r["page"], r["topic_id"], r["is_continuation"], r["title"], r["summary"]))
    for path, _, pages, reply in rows:
        assert sorted(got.get(path, [])) == sorted(page_topics(reply, pages, 2)), (pages, reply)
    assert sum(map(len, got.values())) > 50


def test_no_reply_raises_and_good_entries_stay(spark):
    rng = random.Random(22)
    replies = [_random_reply(rng) for _ in range(200)]
    df = spark.createDataFrame([(str(i), 0, 9, 0, r) for i, r in enumerate(replies)], "path string, window_no int, n_lines int, line_offset int, reply string")
    jsonx.parse_text_topics(df).collect()
    ranks = spark.createDataFrame([(str(i), [0, 1], r) for i, r in enumerate(replies)], "query_id string, candidates array<int>, reply string")
    rerank.parse_ranks(ranks).collect()
    odd = ['[{"title": "T", "ranges": [[1, 2], 7, ["3", 4.9]]}, 5, {"title": 3, "ranges": [[1, 1]]}]']
    df = spark.createDataFrame([("p", 0, 9, 0, odd[0])], df.schema)
    assert [(r["title"], [tuple(x) for x in r["ranges"]]) for r in jsonx.parse_text_topics(df).collect()] == [("T", [(1, 2), (3, 4)]), ("3", [(1, 1)])]
    said = '[1] then [{"id": 0, "rank": 1}, {"id": "1.5"}, {"id": "1", "rank": "2", "score": true}, 5]'
    got = rerank.parse_ranks(spark.createDataFrame([("q", [0, 1], said)], ranks.schema)).collect()
    assert [(r["id"], r["rank"], r["score"]) for r in got] == [(0, 1, 0.0), (1, 2, 1.0)]
