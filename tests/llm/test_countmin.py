import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillfin.llm import countmin
from quillfin.llm.countmin import drop_repeated, packed_gaps, unpacked_gaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    """Expected (n_words, n_removed, kept words) per row, from a dictionary of all windows."""
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and least[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def sample_rows(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "漢字"]
    passage = [r.choices(vocabulary, k=k) for k in (13, 14, 30, 60)]
    rows = [(None, " ".join(passage[3])), (3, None), (4, ""), (5, " \n\t"), (6, " ".join(["same"] * 40)), (900, "same " * 50)]
    for i in range(10, 90):
        words = r.choices(vocabulary, k=r.randrange(60))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passage)
        sep = r.choice([" ", "\n", "  \t"])
        rows.append((i * 7 % 101, sep.join(words)))
    return [*rows, rows[20], (1000, rows[20][1]), (1000, rows[30][1])]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_words string, id string")
    got = drop_repeated(docs.repartition(3)).collect()
    key = lambda x: tuple(map(str, x))
    have = sorted(((g["doc_id"], g["n_words"], g["n_removed"], " ".join(WORD.findall(g["kept_text"] or ""))) for g in got), key=key)
    assert have == sorted(brute(rows), key=key)
    for g in got:
        kept = " ".join(WORD.findall(g["kept_text"] or ""))
        assert g["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert g["id"] == "y" and (g["n_removed"] or g["kept_text"] == g["text"])


def test_against_all_windows(spark):
    check(spark, sample_rows())


def test_many_chunks_segments_and_buckets(spark, monkeypatch):
    # The driver's settings travel with the functions that it sends to the tasks.
    monkeypatch.setattr(countmin, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(countmin, "WINDOWS_PER_SEGMENT", 50)
    check(spark, sample_rows(2))


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(countmin, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(countmin, "segment_edges", lambda n: np.array([0, 4, 16], np.int64))
    check(spark, sample_rows(3))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated(docs).collect() == []


@pytest.mark.parametrize("values", [[], [0], [0, 0, 1, 127, 128, 255, 16_383, 16_384, 2**28, 2**34, 2**34]])
def test_gaps_round_trip(values):
    data = np.frombuffer(packed_gaps(np.array(values, np.int64)), np.uint8)
    assert unpacked_gaps(data).tolist() == values


def test_rows_equal_in_all_columns_are_combined_and_come_back(spark):
    r = random.Random(5)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    rows = [(7, text)] * 300 + [(9, text)] * 200 + [(7, "other " + text), (None, text), (None, text)]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batches = countmin._dealt(docs, "doc_id", "text", 4)
    assert batches.count() < 20 and batches.agg({countmin._COPIES: "sum"}).first()[0] == len(rows)


def test_columns_of_any_type_and_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a", {"k": 1}, 5), (1, "a", {"k": 2}, 5)], "doc_id long, text string, m map<string,int>, segment int")
    assert sorted(r["m"]["k"] for r in drop_repeated(docs).where("segment = 5").collect()) == [1, 2]


def passed(n_windows, chunks, shared):
    """Cells of ``n_windows`` random windows dealt to chunks, of which the first ``shared`` are in all of them,
    through the sketch: the share of unique and of shared windows that pass, segment by segment, and bytes a window."""
    r = np.random.default_rng(6)
    edges = countmin.segment_edges(n_windows)
    bits = int(edges[-1]).bit_length() - 1
    common = r.integers(0, 1 << 63, shared, dtype=np.uint64) << np.uint64(1)
    # Of a large sketch one segment is tried, filled as all are.
    lo, hi = int(edges[0]), int(edges[1])
    per_chunk = n_windows // (len(edges) - 1) // chunks
    own, sent = [], 0
    for c in range(chunks):
        cells = np.unique(np.append(r.integers(lo, hi, per_chunk), (common >> np.uint64(64 - bits)).astype(np.int64) % (hi - lo)))
        own.append((c, cells, packed_gaps(cells)))
        sent += len(own[-1][2])
    group = pa.table({"segment": pa.array([0] * chunks, pa.int64()), "chunk": pa.array(range(chunks), pa.int64()), "gaps": pa.array([x[2] for x in own], pa.binary())})
    merged = countmin._merged(group)
    both = (common >> np.uint64(64 - bits)).astype(np.int64) % (hi - lo)
    unique_hits = shared_hits = n_unique = 0
    for (_, cells, _), b in zip(own, merged.column("bits")):
        twice = np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=len(cells)).astype(bool)
        is_shared = np.isin(cells, both)
        shared_hits += int(twice[is_shared].all())
        unique_hits += twice[~is_shared].sum()
        n_unique += (~is_shared).sum()
    return unique_hits / n_unique, shared_hits == chunks, sent / (n_unique + shared * chunks)


@pytest.mark.parametrize("n_windows, chunks", [(400_000_000, 400), (4_000_000_000, 4_000), (40_000_000_000, 4_000)])
def test_the_filter_works_alike_at_any_size(n_windows, chunks):
    unique, shared, width = passed(n_windows, chunks, 50)
    assert unique < 2.5 / countmin.CELLS_PER_WINDOW and shared and width < 5
