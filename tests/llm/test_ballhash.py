import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillfin.llm import ballhash
from quillfin.llm.ballhash import MASKS, _across, _joins, _packed, _points, _within, links, near_duplicates, similar_documents, simhashes
from quillfin.llm.components import components
from quillfin.llm.fingerprint import signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_simhash(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items):
    """Smallest id reachable, from all pairs."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in items:
        for j, y in items:
            if i < j and (x ^ y).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def sample_texts(seed=5):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta", "é", "漢字", "x" * 40]
    texts = [None, "", " \n", "One", "one", "one two", *(" ".join(r.choices(vocabulary, k=r.randrange(1, 60))) for _ in range(60))]
    long = " ".join(f"w{i}" for i in range(3000))
    return [*texts, texts[10], texts[10], long, long + " tail", long.replace("w77 ", "w78 ")]


def test_simhash_is_the_majority_of_bits():
    texts = sample_texts()
    assert simhashes(pa.array(texts)).tolist() == [plain_simhash(t) for t in texts]
    assert simhashes(pa.array([], pa.string())).tolist() == []


def test_half_balls_meet_for_every_pair_within_three_bits():
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64) & r.getrandbits(64) if r.random() < 0.5 else r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randrange(1, 4)):
            b ^= 1 << bit
        fps = np.array([a, b], np.uint64)
        index, code = _points(fps)
        points = fps[index] ^ MASKS[code]
        near = [set(points[(index == i) & (code < 65)].tolist()) for i in (0, 1)]
        ball = [set(points[index == i].tolist()) for i in (0, 1)]
        assert near[0] & ball[1] or near[1] & ball[0]


@pytest.mark.parametrize("per_bucket", [500, 10_000_000])
def test_links_connect_what_all_pairs_connect(spark, per_bucket):
    r = random.Random(2)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randrange(6)):
            for bit in r.sample(range(64), r.randrange(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    edges = links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), per_bucket)
    got = {row["node"]: row["component"] for row in components(edges).collect()}
    want = plain_components(sorted((x, x % 2**64) for x in signed))
    assert {x: got.get(x, x) for x in signed} == want
    for row in edges.collect():
        assert ((row["a"] ^ row["b"]) % 2**64).bit_count() <= 3


def test_packed_points_are_all_points():
    fps = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    batch = _packed(fps, 7)
    points = []
    for f, i, c in zip(*(batch.column(x).to_pylist() for x in ("fps", "times", "code"))):
        points += (np.repeat(np.frombuffer(f, np.uint64), np.frombuffer(i, np.uint16)) ^ MASKS[np.frombuffer(c, np.uint16)]).tolist()
    index, code = _points(fps)
    assert sorted(points) == sorted((fps[index] ^ MASKS[code]).tolist())


def test_documents_against_brute_force(spark):
    texts = sample_texts()
    rows = [(i * 3, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long").repartition(4)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in near_duplicates(docs).collect()}
    prints = {i: plain_simhash(t) for i, t, *_ in rows}
    want = plain_components(sorted(prints.items()))
    assert got == {i: (prints[i], want[i]) for i in prints}


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(odd).collect()))
    assert got == [(-1, 7), (7, 7), (7, 7), (9, 9)]


def test_components_of_a_long_chain_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_narrow_balls_leave_the_upper_bits_alone(spark):
    r = random.Random(6)
    fps = []
    for table in range(3):
        for _ in range(10):
            x = r.getrandbits(40)
            fps.append(table << 40 | x)
            for bit in r.sample(range(40), 3):
                x ^= 1 << bit
            fps.append(table << 40 | x)
    edges = links(spark.createDataFrame([(x,) for x in set(fps)], "fp long"), 2_000, width=40, tables=3).collect()
    assert all((e["a"] ^ e["b"]).bit_count() <= 3 and e["a"] >> 40 == e["b"] >> 40 for e in edges)
    linked = {frozenset((e["a"], e["b"])) for e in edges}
    assert all(frozenset(p) in linked for p in zip(fps[::2], fps[1::2]))


def test_similar_documents_of_a_table(spark):
    r = random.Random(7)
    word = lambda: f"w{r.randrange(10**6)}"
    rows, groups = [], {}
    for g in range(120):
        base = [word() for _ in range(r.randrange(60, 400))]
        for copy in range(r.randrange(1, 5)):
            w = list(base)
            # Each changed word takes five shingles out: at most 2 % keeps the similarity over 0.8.
            for i in r.sample(range(len(w)), copy and len(w) // 60):
                w[i] = word()
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(w), "x"))
    rows += [(9000, None, "x"), (9001, " ", "x"), (9002, rows[0][1], "x"), (9002, rows[0][1], "x"), (9003, "short text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    got = [(x["doc_id"], x["component_id"]) for x in similar_documents(docs).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert (found[9000], found[9001], found[9002], found[9003]) == (9000, 9000, found[0], 9003)
    first = {g: min(i for i, x in groups.items() if x == g) for g in groups.values()}
    # No two groups are ever joined, and nearly all copies find their group.
    assert all(groups[c] == groups[i] for i, c in got if i < 9000)
    assert sum(found[i] == first[g] for i, g in groups.items()) >= 0.97 * len(groups)
    assert similar_documents(docs.limit(0)).collect() == []


def plain_shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def shared(a, b):
    return len(a & b) / len(a | b)


def joined_groups(got):
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, []).append(i)
    return groups


@pytest.mark.parametrize("block", [4_096, 50])
def test_copies_among_templated_pages_are_all_linked(spark, monkeypatch, block):
    monkeypatch.setattr(ballhash, "BLOCK_NODES", block)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    template, texts, copies = [word() for _ in range(150)], [], []
    for page in range(2_000):
        texts.append(" ".join(template + [word() for _ in range(30 + page % 4 * 8)]))
    for page in r.sample(range(2_000), 400):
        w = texts[page].split()
        for i in r.sample(range(len(w)), 3):
            w[i] = word()
        copies.append((page, len(texts)))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in similar_documents(docs).collect()}
    bits = np.packbits(signatures(pa.array(texts), 512, 1, 5), axis=1)
    prints = bits[:, :30].reshape(len(texts), 6, 5)
    n = 0
    for a, b in copies:
        meet = (np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= 3).any()
        estimate = 1 - 2 * np.bitwise_count(bits[a] ^ bits[b]).sum() / 512
        if meet and estimate >= 0.746 and shared(plain_shingles(texts[a]), plain_shingles(texts[b])) >= 0.8:
            assert got[a] == got[b]
            n += 1
    assert n > 300


def test_links_have_the_exact_similarity(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for g in range(300):
        # Pairs of a common passage of 400 shingles and tails of their own, similar from 0.70 to 0.89.
        passage, tail = [word() for _ in range(404)], 25 + g % 60
        texts += [" ".join(passage + [word() for _ in range(tail)]) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in similar_documents(docs).collect()}
    found = missed = 0
    for a in range(0, len(texts), 2):
        alike = shared(plain_shingles(texts[a]), plain_shingles(texts[a + 1])) >= 0.8
        assert alike or got[a] != got[a + 1]
        found += alike and got[a] == got[a + 1]
        missed += alike and got[a] != got[a + 1]
    assert found >= 0.9 * (found + missed) and found > 100
    assert all(len(g) <= 2 for g in joined_groups(got).values())


def test_a_large_group_of_alike_sketches_makes_no_more_pairs_than_members():
    n = 500
    group = pa.table({"node": range(n), "label": range(n), "own": [True] * n, "sketch": [bytes(64)] * n})
    pairs = _across(group, 0.7).to_pylist()
    assert len(pairs) == n - 1
    assert set(plain_joined(range(n), [(p["a"], p["b"]) for p in pairs]).values()) == {0}


def plain_joined(label, pairs):
    """The smallest label that the pairs of members reach, by member."""
    label = dict(enumerate(label))
    for a, b in pairs:
        lo, hi = sorted((label[a], label[b]))
        label = {i: lo if x == hi else x for i, x in label.items()}
    return label


def test_joins_of_random_graphs_are_a_forest_of_the_same_components():
    r = random.Random(10)
    for _ in range(200):
        n = r.randrange(1, 30)
        label = [r.randrange(n) for _ in range(n)]
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2 * n))}
        edges |= {(b, a) for a, b in edges}
        found = _joins(np.array(label), lambda i: np.array(sorted(b for a, b in edges if a == i), int))
        assert set(found) <= edges
        want = plain_joined(label, edges)
        assert plain_joined(label, found) == want
        assert len(found) == len(set(label)) - len(set(want.values()))


def test_texts_of_a_group_are_joined_as_all_pairs_join_them():
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: r.randrange(20, 60)] + [f"x{r.randrange(40)}"] * r.randrange(3)) for _ in range(120)]
    texts += ["", None, "one", "one two", " ".join(f"z{i}" for i in range(30))]
    label = [i // 2 if i < 20 else i for i in range(len(texts))]
    group = pa.table({"node": range(len(texts)), "label": label, "text": pa.chunked_array([texts[:50], texts[50:]])})
    sets = [plain_shingles(t or "") or {t} for t in texts]
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if texts[a] and texts[b] and shared(sets[a], sets[b]) >= 0.8]
    got = [(p["a"], p["b"]) for p in _within(group, 5, 0.8).to_pylist()]
    # Texts without words are one class before this step, so only two of them are alike here.
    wordless = (len(texts) - 5, len(texts) - 4)
    assert set(got) - {wordless} <= {tuple(sorted(p)) for p in alike}
    assert plain_joined(label, got) == plain_joined(label, [*alike, wordless])
    assert len(got) < len(texts) < len(alike)
