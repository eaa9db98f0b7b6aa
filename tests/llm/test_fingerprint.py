import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quillfin.llm import fingerprint
from quillfin.llm.fingerprint import _densified, edit, edited_pairs, likeness, packed, signatures


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.encode().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def sample(seed=1, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["é", "漢字"]
    out = [None, "", " \n ", "one", "two words", "abc"]
    for _ in range(n):
        out.append(" ".join(r.choices(vocabulary, k=r.randrange(1, 400))))
    return [*out, out[20], "x" * 9, out[20] + " more"]


def test_estimates_are_close_to_the_true_similarity():
    r = random.Random(2)
    texts, changed = [], []
    for _ in range(200):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 900))]
        other = list(w)
        for _ in range(r.randrange(40)):
            other[r.randrange(len(w))] = "new"
        texts.append(" ".join(w))
        changed.append(" ".join(other))
    a, b = signatures(pa.array(texts)), signatures(pa.array(changed))
    none = np.zeros(200, bool)
    error = likeness(a, b, fingerprint.BITS, none, none) - np.array([jaccard(x, y) for x, y in zip(texts, changed)])
    assert abs(error.mean()) < 0.01 and np.abs(error).mean() < 0.03 and np.abs(error).max() < 0.15


def test_short_texts_of_different_words_are_not_alike():
    texts = pa.array([f"word{i}" for i in range(400)])
    s = signatures(texts)
    none = np.zeros(399, bool)
    assert likeness(s[1:], s[:-1], fingerprint.BITS, none, none).max() < 0.2


def test_densification_fills_every_bin_from_a_filled_one():
    least = np.full((3, 64), fingerprint._NONE)
    least[0, 5], least[1, ::7], least[2, :] = 1, np.arange(10), np.arange(64)
    full = _densified(least, 64)
    assert set(full[0]) == {1} and set(full[1]) == set(range(10)) and (full[2] == least[2]).all()
    assert (full[1, ::7] == np.arange(10)).all()


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_packing_keeps_all_bits(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, (4, 16)).astype(np.uint8)
    bytes_ = packed(values, bits)
    assert bytes_.shape == (4, 2 * bits)
    back = np.unpackbits(bytes_, axis=1).reshape(4, 16, bits) @ (1 << np.arange(bits - 1, -1, -1))
    assert (back == values).all()


@pytest.mark.parametrize("part_bytes", [16 << 20, 2_000])
def test_pairs_of_a_table(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(fingerprint, "PARTITION_BYTES", part_bytes)
    texts = sample()
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, tie int, fingerprint string")
    got = {g["doc_id"]: g for g in edited_pairs(docs.repartition(7)).collect()}
    assert len(got) == len(rows)
    by_text: dict = {}
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1] or ""
        changed = edit(t or "", following)
        g = got[i]
        assert g["n_chars"] == len(t or "")
        assert g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        assert by_text.setdefault(t or "", g["fingerprint"]) == g["fingerprint"]
        if (t or "") == changed:
            assert g["fingerprint"] == g["edited_fingerprint"] and g["near_edited"] == 1
        if (t or "").split() and following.split() and not jaccard(t, following):
            assert g["near_next"] < 0.25
    assert got[rows[0][0]]["near_next"] == 1 and got[rows[2][0]]["near_next"] == 0


def test_no_rows_one_row_and_equal_ids(spark):
    schema = "doc_id long, text string"
    assert edited_pairs(spark.createDataFrame([], schema)).collect() == []
    alone = edited_pairs(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert [(g["doc_id"], g["edited_sha256"]) for g in alone] == [(1, hashlib.sha256(b"abcdefab").hexdigest())]
    same = edited_pairs(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c d"), (None, None)], schema)).collect()
    assert sorted(str(g["doc_id"]) for g in same) == ["1", "1", "1", "None", "None"]
