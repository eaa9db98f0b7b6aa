"""The two classifiers: their parts against plain versions, and held-out accuracy on the given tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillfin.llm import boosting, factors, queries
from quillfin.llm.boosting import FEATURES, Lexicon, features, fit_trees, isotonic
from quillfin.llm.factors import BINS, BUCKETS, Machine, Sparse, fit, joined, word_features

SF = "/root/testdata/sf0.01"


def test_interactions_equal_the_sum_over_pairs():
    r = np.random.default_rng(1)
    m = Machine(0.3, r.normal(size=20), r.normal(size=(20, 4)), [])
    x = Sparse(np.array([0, 3, 3, 8]), np.array([1, 5, 7, 0, 2, 5, 9, 19]), r.normal(size=8))
    for i, raw in enumerate(m.raw(x)):
        own = range(x.first[i], x.first[i + 1])
        plain = 0.3 + sum(m.w[x.index[a]] * x.value[a] for a in own)
        plain += sum(m.v[x.index[a]] @ m.v[x.index[b]] * x.value[a] * x.value[b] for a in own for b in own if a < b)
        assert raw == pytest.approx(plain)


def test_machine_learns_an_interaction():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 2, (2, 3000))
    index = np.stack([a, 2 + b], 1).ravel()
    x = Sparse(np.arange(0, 6001, 2), index, np.ones(6000))
    m = fit(x, (a ^ b).astype(float), [], epochs=30)
    assert (((m.raw(x) > 0) == (a ^ b)).mean()) > 0.95


def test_statistics_of_a_text():
    texts = [None, "", "one", "The the cat | 7!\nThe end###\n\n the tail", "é" * 30]
    sparse, stats = word_features(pa.array(texts, pa.string()))
    by = dict(zip(factors.STATISTICS, stats[3]))
    assert by["n_words"] == pytest.approx(np.log(10)) and by["equal_neighbours"] == pytest.approx(1 / 9)
    assert by["bars"] == pytest.approx(1 / 38) and by["signs"] == pytest.approx(3 / 38) and by["bangs"] == pytest.approx(1 / 38)
    assert by["distinct_share"] == pytest.approx(6 / 9) and by["equal_line_heads"] == pytest.approx(2 / 4)
    assert np.isfinite(stats).all() and list(np.diff(sparse.first)) == [0, 0, 1, 6, 1]
    whole = joined(sparse, stats, [np.array([0.5])] * stats.shape[1])
    assert list(np.diff(whole.first)) == [16, 16, 17, 22, 17] and (whole.index < BUCKETS + 16 * BINS).all()


def test_dense_features_of_a_text():
    word = lambda s: boosting.xxh64(np.frombuffer(s, np.uint8), np.zeros(1, int), np.array([len(s)]))
    stem = boosting.xxh64(np.frombuffer(b"scum", np.uint8), np.zeros(1, int), np.array([4]), 4)
    lexicon = Lexicon({0: (word(b"idiot"), np.array([5.0])), 4: (stem, np.array([3.0]))})
    texts = [None, "", "You are an 1D10T, a scumbag!!", "plain words " * 20 + "idiot", "HEY w0rd sooooo"]
    got = [dict(zip(FEATURES, x)) for x in features(pa.array(texts, pa.string()), lexicon)]
    assert got[0] == got[1] and not any(v for k, v in got[0].items())
    assert got[2]["word_odds"] == 5 and got[2]["stem_odds"] == 3 and got[2]["near_you_hits"] == 2 and got[2]["top_odds"] == 5
    assert got[2]["obfuscated"] > 0 and got[2]["exclamations"] > 0
    assert got[3]["word_density"] == pytest.approx(1 / 41) and got[3]["near_you_hits"] == 0
    assert got[4]["shouted_words"] == pytest.approx(1 / 3) and got[4]["obfuscated"] == pytest.approx(1 / 3) and got[4]["drawn_out"] > 0


def test_trees_fit_a_rule_and_isotonic_pools():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(int)
    assert ((fit_trees(x[:1500], y[:1500]).raw(x[1500:]) > 0) == y[1500:]).mean() > 0.97
    at, rate = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0, 1, 0, 1, 1]))
    assert rate.tolist() == [0, 0.5, 1] and at.tolist() == [1, 2.5, 4.5]
    raw = r.normal(size=300)
    at, rate = isotonic(raw, (r.random(300) < 1 / (1 + np.exp(-raw))).astype(int))
    assert (np.diff(at) > 0).all() and (np.diff(rate) > 0).all()
    assert len(isotonic(np.zeros(0), np.zeros(0))[0]) == 0 and len(fit_trees(np.zeros((0, 2)), np.zeros(0)).raw(np.zeros((1, 2)))) == 1


@pytest.mark.parametrize("name, label, least", [("op2_factorisation_quality", "quality", 0.95), ("op7_boosted_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.shown.queries[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    row = right.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert row[0] >= least and 0 <= row[1] <= row[2] <= 1 and row[3] > 30


@pytest.mark.parametrize("module, label", [(factors, "quality"), (boosting, "toxic")])
def test_odd_tables(spark, module, label):
    r = random.Random(5)
    text = lambda bad: " ".join(r.choices(["vile"] * bad + [f"w{i}" for i in range(50)], k=40))
    rows = [(i, text(i % 2 * 20), "clash", 1) for i in range(120)] + [(500, None, "x", 2), (501, "", "x", None), (502, "é" * 50_000, "x", 3), (502, "twice", "x", 3), (None, "no id", "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (3, None), (4, 0), (4, 1)], f"doc_id long, {label} int")
    model = module.learn(docs, labels, label)
    got = module.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got) and all(g["label"] in ("clash", "x") for g in got)
    high = np.mean([g["score"] > 0.5 for g in got if g["doc_id"] is not None and g["doc_id"] < 120 and g["doc_id"] % 2 == 1])
    low = np.mean([g["score"] > 0.5 for g in got if g["doc_id"] is not None and g["doc_id"] < 120 and g["doc_id"] % 2 == 0])
    assert high > 0.9 and low < 0.1
    none = module.learn(docs, labels.limit(0), label)
    assert {g["score"] for g in module.scored(docs, none).collect()} == {0.5}
    assert module.scored(docs.limit(0), model).collect() == []


def test_plain_words_fold_signs():
    w, _ = boosting._terms(pa.array(["1D10T! Sh1t-head @ll", None]))
    words = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert words == re.findall(r"\S+", "idiot shit head all")


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    r = random.Random(4)
    texts = [None, "", "abc def", "baa", "aabb", "é́", "YOU 1diot!!!", "!!!", "a", "aa"] + ["".join(r.choice("aA !1é\n") for _ in range(r.randrange(30))) for _ in range(200)]
    words_ = np.frombuffer(b"youabc", np.uint8)
    known = np.sort(boosting.xxh64(words_, np.array([0, 3]), np.array([3, 6])))
    lexicon = Lexicon({0: (known, np.array([2.0, 1.0]))})
    together = features(pa.array(texts, pa.string()), lexicon)
    for order in (sorted(range(len(texts)), key=lambda i: r.random()), range(len(texts))):
        for cut in (1, 7):
            for at in range(0, len(texts), cut):
                part = list(order)[at : at + cut]
                np.testing.assert_array_equal(features(pa.array([texts[i] for i in part], pa.string()), lexicon), together[part])
