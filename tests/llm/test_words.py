import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from quillfin.llm.words import chained, rows_in_steps, words, xxh64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(seed: int, n: int = 200) -> list[str | None]:
    r = random.Random(seed)
    alphabet = "abAZé漢😀 \t\n\x0b\x0c\r\x1c\x85\xa0.!"
    return [None, "", " ", *("".join(r.choices(alphabet, k=r.randrange(120))) for _ in range(n)), "x" * 5000]


def test_words_and_hashes_match_a_plain_split():
    texts = random_texts(1)
    for lower in (False, True):
        got = words(pa.array(texts), lower)
        for i, t in enumerate(texts):
            plain = WORD.findall(t or "")
            if lower:
                plain = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in plain]
            span = range(got.first[i], got.first[i + 1])
            assert [got.data[got.start[j] : got.end[j]].tobytes().decode() for j in span] == plain
        for k in (1, 3, 7):
            begin, count, bounds = got.runs(k, whole_if_shorter=True)
            h = got.hashes(begin, count, 42)
            for i, t in enumerate(texts):
                w = [got.data[got.start[j] : got.end[j]].tobytes().decode() for j in range(got.first[i], got.first[i + 1])]
                want = [" ".join(w[j : j + k]) for j in range(len(w) - k + 1)] or [" ".join(w)] * bool(w)
                assert h[bounds[i] : bounds[i + 1]].tolist() == [xxhash.xxh64_intdigest(x, 42) for x in want]


def test_xxh64_of_every_length():
    data = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    start = np.arange(200)
    for seed in (0, 42, 2**64 - 1):
        got = xxh64(data, start, np.arange(200), seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + s].tobytes(), seed) for s in range(200)]


def test_steps_cover_all_rows_once():
    a = pa.array(["x" * n for n in (0, 5, 50, 3, 3, 3, 0)])
    steps = list(rows_in_steps(a, 8))
    assert [i for b, e in steps for i in range(b, e)] == list(range(7))
    assert list(rows_in_steps(pa.array([], pa.string()))) == []


def test_chained_hashes_tell_sequences_apart():
    r = np.random.default_rng(3)
    h = r.integers(0, 3, 500).astype(np.uint64)
    for k in (1, 2, 5, 8, 13):
        got = chained(h, k)
        plain = [tuple(h[i : i + k]) for i in range(500 - k + 1)]
        assert len(got) == len(plain)
        assert len(set(zip(got.tolist(), plain))) == len(set(plain)) == len(set(got.tolist()))
