import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.llm import crossparse
from quillfin.llm.crossparse import SuffixAutomaton, build, identify, learn, normal, phrases, predict

WORDS = {
    "aa": "karo mit lunde vesk omra tilo".split(),
    "bb": "zyx quab nerr xill wop jarr".split(),
    "漢": "的是 不了 在人 有我".split(),
}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", ".", ",", "!"]) for _ in range(n))


def greedy(doc: str, samples: list[str], letters: set[str]) -> int:
    """Phrases of the longest-match parse, by substring search."""
    at, count = 0, 0
    while at < len(doc):
        end = at + 1
        while end < len(doc) and any(doc[at : end + 1] in s for s in samples):
            end += 1
        count += 1
        at = end
    return count


def test_automaton_has_exactly_the_substrings():
    r = random.Random(1)
    for _ in range(30):
        texts = ["".join(r.choices("abc", k=r.randrange(1, 15))) for _ in range(r.randrange(1, 4))]
        a = SuffixAutomaton()
        for t in texts:
            for c in t:
                a.add(ord(c))
            a.break_()
        want = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for n in range(1, 5):
            for _ in range(60):
                s = "".join(r.choices("abc", k=n))
                state, ok = 0, True
                for c in s:
                    if ord(c) not in a.next[state]:
                        ok = False
                        break
                    state = a.next[state][ord(c)]
                assert ok == (s in want)


@pytest.mark.parametrize("block", [4096, 7])
def test_phrases_match_a_plain_parse(monkeypatch, block):
    monkeypatch.setattr(crossparse, "BLOCK", block)
    r = random.Random(2)
    samples = {lang: [text(r, lang, 12) for _ in range(4)] for lang in WORDS}
    models = build(samples)
    size = min(sum(len(normal(t)) for t in s) for s in samples.values())
    used = {}
    for lang, s in samples.items():
        left, used[lang] = size, []
        for t in map(normal, s):
            used[lang].append(t[:left])
            left -= min(left, len(t))
    docs = ["", "?", "Q", "KARO mit", *(normal(text(r, r.choice(list(WORDS)), r.randrange(1, 30))) for _ in range(40))]
    found, n, has_letter = phrases(docs, models)
    for d, row, k, ok in zip(docs, found, n, has_letter):
        plain = d.lower().replace("?", " ")
        assert k == len(plain) and ok == any(c.isalpha() for c in d)
        for lang, c in zip(models.langs, row):
            cuts = [plain[i : i + block] for i in range(0, len(plain), block)]
            assert c == sum(greedy(x, used[lang], set(models.letters)) for x in cuts)


def test_languages_of_a_table(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        lang = r.choice(list(WORDS))
        rows.append((i, text(r, lang, r.randrange(8, 80)), lang, 0.5))
    rows += [(900, None, "aa", 0.5), (901, "", None, 0.5), (902, "12 ?! 7", "bb", 0.5), (903, rows[0][1], None, 0.5), (903, rows[0][1], None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    held = F.expr("crc32(cast(doc_id as string)) % 3 = 1")
    models = learn(docs, where=~held)
    got = {g["doc_id"]: g for g in identify(docs, models).collect()}
    assert Counter(type(g["score"]) for g in got.values()) == {float: 244} and all(0 <= g["score"] <= 1 for g in got.values())
    assert all(got[i]["lang_pred"] == lang for i, t, lang, _ in rows[:240])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == rows[0][2]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "karo", None)], "doc_id long, text string, lang string")
    assert identify(docs, learn(docs)).first()["lang_pred"] == "und"
    assert identify(docs.limit(0), learn(docs.limit(0))).collect() == []
    assert predict([], build({"aa": ["karo"]}))[0] == []


def test_models_are_bounded():
    r = random.Random(4)
    many = {f"l{i:02}": ["".join(r.choices("abcdefgh ", k=30_000))] for i in range(20)}
    models = build(many)
    assert len(models.table) * 4 < 64 << 20 and np.allclose(models.bits, models.bits[0])


def test_a_language_of_one_short_text_leaves_the_others_alone(spark):
    r = random.Random(5)
    # Languages of the same letters and the same short words; only longer runs tell them apart.
    parts = ["ka", "ro", "mi", "lu", "te", "so"]
    vocabulary = {lang: ["".join(r.choices(parts, k=3)) for _ in range(60)] for lang in ("aa", "bb", "cc")}
    rows = []
    for i in range(360):
        lang = r.choice(list(vocabulary))
        rows.append((i, " ".join(r.choices(vocabulary[lang], k=r.randrange(8, 40))), lang))
    held = F.expr("crc32(cast(doc_id as string)) % 3 = 1")

    def accuracy(extra):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").repartition(4)
        named = identify(docs, learn(docs, where=~held | F.expr("doc_id >= 1000"))).where(held & F.expr("doc_id < 1000")).collect()
        return sum(g["lang_pred"] == g["lang"] for g in named) / len(named)

    assert accuracy([]) > 0.98
    assert accuracy([(1000, "karo milu teso kami", "xx")]) > 0.98
    assert accuracy([(1000, "k", "xx")]) > 0.98


SCRIPTS = {
    "thai": (0x0E01, 0x0E2F, "\u0e31\u0e34\u0e35\u0e38\u0e48\u0e49"),
    "devanagari": (0x0915, 0x093A, "\u093e\u093f\u0940\u0941\u0947\u094d"),
    "armenian": (0x0561, 0x0587, ""),
    "hangul": (0xAC00, 0xAE00, ""),
    "han": (0x4E00, 0x5000, ""),
    "greek": (0x03B1, 0x03CA, ""),
    "cyrillic": (0x0430, 0x0450, ""),
    "arabic": (0x0627, 0x063B, ""),
    "hebrew": (0x05D0, 0x05EB, ""),
    "georgian": (0x10D0, 0x10F1, ""),
}


def test_eighty_labels_in_ten_scripts():
    r = random.Random(6)
    vocabulary = {}
    for name, (low, high, marks) in SCRIPTS.items():
        letters = [chr(i) for i in range(low, high) if chr(i).isalpha()]
        for nth in range(8):
            word = lambda: "".join(r.choice(letters) + (r.choice(marks) if marks and r.random() < 0.5 else "") for _ in range(r.randrange(2, 7)))
            vocabulary[f"{name}{nth}"] = [word() for _ in range(50)]
    made = lambda lang: " ".join(r.choices(vocabulary[lang], k=r.randrange(15, 50)))
    models = build({lang: [made(lang) for _ in range(25)] for lang in vocabulary}, same_size=False)
    assert len(models.langs) == 80 and len(models.letters) > 1000
    for lang in vocabulary:
        named, _ = predict([made(lang) for _ in range(20)], models)
        assert named.count(lang) >= 19, lang


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5200 + i)} " * 20, f"l{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    assert all(g["lang_pred"] == g["lang"] for g in identify(docs, learn(docs)).collect())


def test_marks_alone_are_no_letters():
    assert predict(["\u0e31\u0e34", "\u0e01\u0e34"], build({"th": ["\u0e01\u0e34\u0e02"]}))[0] == ["und", "th"]
