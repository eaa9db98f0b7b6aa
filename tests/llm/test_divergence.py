import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillfin.llm import divergence
from quillfin.llm.divergence import Reference, judge, js_distance, references
from quillfin.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed,
    )


def sample(seed=1):
    r = random.Random(seed)
    langs = {"en": ["the", "of", "and", *[f"e{i}x" for i in range(300)]], "漢": ["的", "是", *[f"漢{i}" for i in range(300)]]}
    rows = [(0, None, "en"), (1, "", None), (2, "\n\n", "en"), (3, "a\nb\na\n\n \na", "en"), (4, "x " * 30, "en"), (5, "é" * 70_000, None)]
    for i in range(6, 190):
        lang = r.choice(list(langs))
        v = langs[lang]
        w = r.choices(v, [1 / (k + 1) for k in range(len(v))], k=r.randrange(5, 160))
        text = "".join(x + r.choice([" ", " ", " ", "\n", "\t "]) for x in w)
        rows.append((i, text + r.choice(["", text[:40], "\n" + text]), r.choice([lang, lang, None])))
    for i in range(190, 195):
        rows.append((i, " ".join(x.upper() + "###" for x in r.choices(langs["en"], k=120)), "en"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, kept string, extra int")


def test_base_counts_and_verdicts(spark):
    rows = sample()
    got = {g["doc_id"]: g for g in judge(frame(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == base(text)
        assert g["extra"] == 1 and (g["class_distance"] is None) == (g["n_words"] < 50)
        assert not (g["kept"] and g["base_failed"])
    plain = [got[i]["kept"] for i in range(6, 190) if not got[i]["base_failed"]]
    assert all(plain) and len(plain) > 30
    assert not any(got[i]["kept"] for i in range(190, 195))


@pytest.mark.parametrize("part_words", [1_000_000, 10])
def test_references_are_exact_counts(spark, monkeypatch, part_words):
    monkeypatch.setattr(divergence, "PART_WORDS", part_words)
    rows = sample(2)
    found = references(frame(spark, rows).repartition(4), common=0.02)
    for r in found:
        all_words = Counter(w for _, t, lang in rows if lang == r.lang for w in WORD.findall(t or ""))
        n = sum(all_words.values())
        want = sorted((int(h), c / n) for w, c in all_words.items() for h in hashed(w) if c >= 0.02 * n)
        assert [int(x) for x in r.words] == [h for h, _ in want]
        assert r.word_shares[:-1].tolist() == pytest.approx([s for _, s in want])
        assert r.word_shares.sum() == pytest.approx(1) and r.class_shares.sum() == pytest.approx(1)
    assert {r.lang for r in found} == {"en", "漢"}


def test_rare_language_over_many_parts_sends_few_words_to_the_driver(spark, monkeypatch):
    # A thousand words that are frequent in one part each, and a few that are so everywhere.
    r = random.Random(7)
    rows = []
    for i in range(200):
        own = [f"p{i}w{k}" for k in range(20)]
        rows.append((i, " ".join(r.choices([*own, "the", "of", "and"], k=90)), "xx"))
    near = divergence._near_common
    seen = []
    monkeypatch.setattr(divergence, "_near_common", lambda summed, common: seen.append((summed.count(), near(summed, common).count())) or near(summed, common))
    (found,) = references(frame(spark, rows).repartition(200), common=0.01)
    sent, left = seen[0]
    assert sent > 3_000 and left <= 1 / 0.01 / (1 - 1 / divergence.FINER)
    counts = Counter(w for _, t, _ in rows for w in t.split())
    want = {int(h): c / 18_000 for w in counts for h, c in [(hashed(w)[0], counts[w])] if c >= 180}
    assert dict(zip((int(x) for x in found.words), found.word_shares.tolist())) == pytest.approx(want) and len(want) == 3


def hashed(word):
    w = words(pa.array([word]))
    return w.hashes(np.zeros(1, int), np.ones(1, int)).tolist()


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([0.25, 0.75, 0.0])
    m = (p[0] + q) / 2
    plain = math.sqrt(sum(x * math.log2(x / y) for x, y in zip(p[0], m) if x) / 2 + sum(x * math.log2(x / y) for x, y in zip(q, m) if x) / 2)
    assert js_distance(p, q).tolist() == pytest.approx([plain, 1.0])


def test_no_reference_and_no_rows(spark):
    assert judge(frame(spark, [])).collect() == []
    alone = judge(frame(spark, [(1, " ".join(f"w{i}" for i in range(60)), None)])).first()
    assert alone["kept"] and alone["class_distance"] is None
    ref = [Reference("x", np.full(8, 1 / 8), np.zeros(0, np.uint64), np.ones(1))]
    assert judge(frame(spark, [(1, "word " * 5, None)]), reference=ref).first()["base_failed"]
