import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillfin.llm import merkle
from quillfin.llm.merkle import Node, grown, manifest, replaced, tampered


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lifted(nodes):
    """All levels of a tree by the rule as worded."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def climbed(levels, at):
    """The run and the place in it at each level from the node at ``at``."""
    out = []
    for level in levels[:-1]:
        begin = at // 16 * 16
        out.append((level[begin : begin + 16], at - begin))
        at //= 16
    return out


def brute(docs):
    """doc_id -> (leaf, subroot, root, proof, folded, verified); ids are unique."""
    by_source: dict = {}
    for d in docs:
        by_source.setdefault(d[1], []).append(d)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda d: (d[0] is not None, d[0] or 0))
        trees[s] = lifted([leaf_of(d) for d in by_source[s]])
    top = lifted([trees[s][-1][0] for s in order])
    root, out = top[-1][0], {}
    for k, s in enumerate(order):
        for at, d in enumerate(by_source[s]):
            path = climbed(trees[s], at) + climbed(top, k)
            proof = h("".join("".join(run[:i] + run[i + 1 :]) for run, i in path))
            now = leaf_of(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                now = leaf_of((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])))
            for run, i in path:
                now = h("".join(run[:i] + [now] + run[i + 1 :]))
            out[d[0]] = (leaf_of(d), trees[s][-1][0], root, proof, now, now == root)
    return out


def corpus(n, seed=0):
    r = random.Random(seed)
    docs = [(0, None, None, None, None), (1, "", "en", 0, ""), (2, "lone", "de", 5, "ÄB É")]
    for i in range(3, n):
        source = r.choice(["hot", "hot", "hot", "hot", "a", "B", "é", None])
        docs.append((i, source, r.choice(["en", None]), r.choice([None, i]), r.choice(["Text A", "text", None, "x" * r.randrange(3000), "Ünï CODE"])))
    return docs


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
def found(spark, docs, parts=5, levels=merkle.LEVELS):
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    df = spark.createDataFrame(docs, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).repartition(parts)
    return manifest(tampered(df, fifth), levels=levels).collect()


def as_tuple(g):
    return (g["leaf"], g["subroot"], g["root"], g["proof_sha256"], g["folded_root"], g["verified"])


@pytest.mark.parametrize("n,parts", [(900, 7), (40, 1)])
def test_manifest_agrees_with_the_plain_way(spark, n, parts):
    docs = corpus(n)
    got = found(spark, docs, parts)
    assert {g["doc_id"]: as_tuple(g) for g in got} == brute(docs) and len(got) == n
    assert {g["verified"] for g in got} == {True, False}


def test_blocks_of_several_tiers(spark):
    """Blocks of one level, so that trees of hundreds of leaves and of sources have three tiers."""
    docs = corpus(500, 3) + [(1000 + i, f"s{i:03}", "en", 1, "One") for i in range(300)]
    assert {g["doc_id"]: as_tuple(g) for g in found(spark, docs, levels=1)} == brute(docs)


def test_versions_share_what_they_do_not_copy():
    root, height = grown([h(str(i)) for i in range(256)], None)
    assert height == 2
    new = replaced(root, merkle._turns(37, height), h("other"))
    assert [n.digest for n in new] != [root.digest] and len(new) == 3
    assert sum(a is b for a, b in zip(root.kids, new[0].kids)) == 15
    assert sum(a is b for a, b in zip(root.kids[2].kids, new[0].kids[2].kids)) == 15
    back = replaced(new[0], merkle._turns(37, height), h("37"))
    assert back[0].digest == root.digest
    assert isinstance(back[0], Node)


def test_repeated_rows_and_ids(spark):
    """A third of all rows are one row; two rows of an id with other texts are two leaves."""
    docs = [(i, "a", "en", 1, f"Text {i}") for i in range(400)] + [(7, "a", "en", 1, "Same")] * 300 + [(None, "a", None, None, None)] * 2
    got = found(spark, docs, 6)
    leaves = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
    levels = lifted([leaf_of(d) for d in leaves])
    assert {g["root"] for g in got} == {levels[-1][0]}
    want = [(leaf_of(d), h("".join("".join(run[:i] + run[i + 1 :]) for run, i in climbed(levels, at)))) for at, d in enumerate(leaves)]
    assert sorted((g["leaf"], g["proof_sha256"]) for g in got) == sorted(want)


def test_tables_of_no_and_one_row(spark):
    assert found(spark, []) == []
    lone = found(spark, [(5, "a", "en", 3, "ABC")])
    want = leaf_of((5, "a", "en", 3, "ABC"))
    assert [as_tuple(g)[:4] for g in lone] == [(want, want, want, h(""))]
    copies = {g["doc_id"]: g["copied"] for g in found(spark, [(5, "a", "en", 3, "ABC"), (6, "b", "en", 3, "ABC")])}
    assert {len(c) for c in copies.values()} == {1}
