import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillfin.llm.grouping import byte_bpe, pack, plan_of, spans

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = byte_bpe(RANKS)


def plain_ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def sequences_of(lengths, plan, capacity):
    """Checks that every piece has one place and that sequences are gapless; gives their number."""
    ranks, sequences = Counter(), {}
    for n, begin, end, first, at, copies in plan:
        assert ranks[n] == begin
        ranks[n] = end
        for r in range(end - begin):
            sequences.setdefault(first + r // copies, []).append((at + r % copies * n, n))
    assert +ranks == +Counter(lengths)
    for pieces in sequences.values():
        filled = 0
        for at, n in sorted(pieces):
            assert at == filled
            filled += n
        assert filled <= capacity
    return len(sequences)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=12), st.sampled_from([1, 3, 8]))
def test_every_plan_is_a_packing(capacity, lengths, groups):
    lengths = {n: c for n, c in lengths.items() if n <= capacity}
    sequences_of(lengths, plan_of(lengths, capacity, groups), capacity)


def test_plans_are_close_to_full():
    r = random.Random(1)
    lengths = Counter(min(2048, max(1, int(r.lognormvariate(6.5, 1)))) for _ in range(20_000))
    used = sequences_of(lengths, plan_of(lengths), 2048)
    assert used <= 1.001 * sum(n * c for n, c in lengths.items()) / 2048 + 1
    assert used <= sequences_of(lengths, plan_of(lengths, large=(1.0,)), 2048)


def test_configurations_beat_greedy_where_it_fails():
    # Three sizes that fill a sequence exactly, and greedy choices that don't.
    lengths = {1000: 600, 600: 600, 448: 600}
    assert sequences_of(lengths, plan_of(lengths), 2048) <= 604
    assert sequences_of(lengths, plan_of(lengths, large=(1.0,)), 2048) > 630


def test_plan_size_does_not_follow_the_number_of_documents():
    r = random.Random(2)
    few = Counter(r.randrange(1, 2049) for _ in range(5_000))
    many = Counter({n: 1000 * c for n, c in few.items()})
    assert len(plan_of(many)) < 12_000


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_ids_are_those_of_tokenizers(text):
    assert ENCODE(text) == plain_ids(text)


def test_ids_of_special_tokens_and_long_words():
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 20_000, " " * 3000, "é" * 999, "it's 12 \n\n  !!"):
        assert ENCODE(text) == plain_ids(text)


def test_spans():
    assert spans(1, 4) == [(0, 1)] and spans(4, 4) == [(0, 4)]
    assert spans(5, 4) == [(0, 1), (1, 5)] and spans(8, 4) == [(0, 4), (4, 8)]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_of_a_table(spark, capacity):
    r = random.Random(3)
    texts = [None, "", "one", *(" ".join(r.choices(["alpha", "beta", "été", "漢字"], k=r.randrange(40))) for _ in range(120)), "same text"]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(7, "same text", 5, "x")] * 30 + [(None, "no id", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, part string").repartition(5)
    got = pack(docs, RANKS, capacity=capacity, with_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*plain_ids(t or ""), 0]
        for nth, (a, b) in enumerate(spans(len(ids), capacity)):
            want[(i, nth, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    sequences: dict = {}
    for g in got:
        assert zlib.crc32(g["ids"]) == g["ids_crc32"]
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for pieces in sequences.values():
        filled = 0
        for at, n in sorted(pieces):
            assert at == filled
            filled += n
        assert filled <= capacity


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), RANKS).collect() == []
