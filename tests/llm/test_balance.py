import math
import random

import pytest
from pyspark.sql import functions as F

from quillfin.llm.balance import mixed, targets, word_count


def reshared(sizes: dict, weights=(5, 2, 1), cap=3.0) -> dict:
    """Targets by the rule as worded: share, stop those above their limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= cap * sizes[s]}
        if not above:
            return stopped | share
        stopped |= {s: cap * sizes[s] for s in above}
        free -= above
    return stopped


def rows(seed=0, n=600):
    r = random.Random(seed)
    out = [(0, None, None), (1, "", "b"), (2, "lone", "tiny"), (3, None, "void")]
    for i in range(4, n):
        source = r.choice(["a", "a", "a", "b", "é", "z", None, "", "B"])
        out.append((i, "w " * min(int(r.paretovariate(0.8)), 900), source))
    return [*out, *[(n + i, "same size here", "a") for i in range(200)]]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", word_count(F.col("text"))).withColumn("rate", F.lit("clash"))


def test_targets_reach_their_rule(spark):
    r = random.Random(4)
    for _ in range(6):
        sizes = {s: r.choice([0, 1, 10, 1000, 100_000]) for s in r.sample(["a", "b", "", "é", "Z", "zz", None], r.randrange(1, 8))}
        got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = reshared(sizes)
        assert {g["source"] for g in got} == set(sizes)
        for g in got:
            assert g["target"] == pytest.approx(want[g["source"]], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets_and_limits(spark, seed):
    data = rows(seed)
    got = mixed(frame(spark, data).repartition(5)).collect()
    assert sorted(g["doc_id"] for g in got) == sorted(d[0] for d in data)
    size = {i: len((t or "").split()) for i, t, _ in data}
    by_source: dict = {}
    for i, _, s in data:
        by_source[s] = by_source.get(s, 0) + size[i]
    want = reshared(by_source)
    taken: dict = {}
    for g in got:
        assert g["size"] == size[g["doc_id"]]
        assert g["source_size"] == by_source[g["source"]]
        assert g["target"] == pytest.approx(want[g["source"]], rel=1e-9)
        assert g["taken"] == g["copies"] * g["size"] and 0 <= g["copies"] <= 3
        assert abs(g["copies"] - g["rate"]) < 1
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    for s, t in taken.items():
        largest = max(size[i] for i, _, x in data if x == s)
        assert abs(t - want[s]) <= largest + 1
    again = mixed(frame(spark, data).repartition(2, "doc_id")).collect()
    key = lambda g: (g["doc_id"], g["copies"], round(g["rate"], 9))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_are_the_entropy_optimum(spark):
    """Per source ln(rate) is proportional to size wherever the limit of three does not bind."""
    tilt: dict = {}
    for g in mixed(frame(spark, rows(3))).collect():
        if g["size"] and g["rate"] < 3:
            tilt.setdefault(g["source"], []).append(math.log(g["rate"]) / g["size"])
    assert len(tilt) > 3
    for values in tilt.values():
        assert max(values) - min(values) <= 1e-6 * max(1, abs(values[0]))


def test_tables_without_rows_or_words(spark):
    assert mixed(frame(spark, [])).collect() == []
    got = mixed(frame(spark, [(1, None, None), (2, " ", None)])).collect()
    assert [(g["target"], g["copies"], g["taken"]) for g in got] == [(0.0, 1, 0)] * 2
    same = mixed(frame(spark, [(1, "a b", "s"), (1, "a b", "s")])).collect()
    assert [(g["target"], g["copies"]) for g in same] == [(4.0, 1)] * 2
