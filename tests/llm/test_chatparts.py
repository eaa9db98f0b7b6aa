import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfin.llm.chatparts import (
    Audio, Document, Expansion, Image, Text, conversation_digests, escaped, format_turn, format_turns, read_back, read_turns, text_part, unescaped,
)

BITS = ["<", "|", "\\", ">", "<|im_end|>", "<|im_start|>assistant", "\n", "<|image|>", "<\\|", "a", "é", "\U0001f600", "im_end|>", ""]
texts = st.lists(st.sampled_from(BITS), max_size=12).map("".join)
parts = st.lists(st.one_of(texts.map(Text), st.builds(Image, st.text(max_size=3)), st.builds(Audio, st.none()), st.builds(Document, st.text(max_size=3))), max_size=6)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@given(texts)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert unescaped(escaped(text)) == text
    assert "<|" not in escaped(text)


@settings(max_examples=300)
@given(st.lists(st.tuples(texts, parts), min_size=1, max_size=4))
def test_turns_come_back(turns):
    made = [format_turn(role, content, trained=(turns[0][0],)) for role, content in turns]
    refs = [a["ref"] for m in made for a in m.attachments]
    read = read_turns("".join(m.text for m in made), refs)
    assert len(read) == len(turns)
    for (role, content), (got_role, got), m in zip(turns, read, made):
        assert got_role == role
        want = []
        for p in content:
            if isinstance(p, Text):
                if want and want[-1][0] == "text":
                    want[-1] = ("text", want[-1][1] + p.text)
                else:
                    want.append(("text", p.text))
            else:
                want.append((type(p).__name__.lower(), p.ref))
        assert got == [w for w in want if w != ("text", "")]
        loss = "".join(unescaped(m.text[a:b]) for a, b in m.loss)
        assert loss == ("".join(p.text for p in content if isinstance(p, Text)) if role == turns[0][0] else "")
        for a in m.attachments:
            assert m.text.startswith(f"<|{a['kind']}|>", a["at"])
    assert "".join(m.text for m in made).count("<|im_end|>") == len(turns)


def test_expanded_tokens():
    size = Expansion(patch=10, image=7, audio_per_second=2, audio=5, page=100)
    content = [Image("a", 25, 31), Image("b"), Audio("c", 3.2), Audio("d"), Document("e", 3), Document("f"), Audio("g", float("nan")), Image("h", -5, 3)]
    got = [(a["nth"], a["ref"], a["tokens"]) for a in format_turn("user", content, expansion=size).attachments]
    assert got == [(0, "a", 12), (1, "b", 7), (2, "c", 7), (3, "d", 5), (4, "e", 300), (5, "f", 100), (6, "g", 5), (7, "h", 1)]


def test_typed_content_through_spark(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    part = lambda kind=None, text=None, ref=None, **kw: (kind, text, ref, kw.get("width"), kw.get("height"), kw.get("seconds"), kw.get("pages"))
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", None, "s3://a", width=56, height=28), part("audio", None, "b", seconds=2.0)], "clash"),
        (1, 1, "assistant", [part("text", "one"), part("text", " <|im_end|>"), part("document", None, "c", pages=2), part("text", "two")], "clash"),
        (1, 2, None, None, "clash"),
        (1, 3, "user", [None, part("odd", None, "d"), part(None, "x")], "clash"),
    ]
    schema = "conv_id long, turn long, role string, content array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>, formatted string"
    made = format_turns(spark.createDataFrame(rows, schema), tokenizer_path=path)
    got = sorted(read_back(made).collect(), key=lambda r: r["turn"])
    count = lambda *runs: sum(len(Tokenizer.from_file(path).encode(r, add_special_tokens=False).ids) for r in runs)
    assert [r["read_role"] for r in got] == ["user", "assistant", "", "user"]
    assert [[tuple(p) for p in r["read_parts"]] for r in got] == [
        [("text", "see <|image|> "), ("image", "s3://a"), ("audio", "b")],
        [("text", "one <|im_end|>"), ("document", "c"), ("text", "two")],
        [],
        [("document", "d"), ("text", "x")],
    ]
    assert [[a["tokens"] for a in r["attachments"]] for r in got] == [[2, 50], [2048], [], [1024]]
    assert [r["text_tokens"] for r in got] == [count("see <\\|image|> "), count("one <\\|im_end|>", "two"), 0, count("x")]
    assert [r["expanded_tokens"] - r["text_tokens"] for r in got] == [54, 2050, 2, 1026]
    assert [len(r["loss"]) for r in got] == [0, 2, 0, 0]


def plain(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        said = [r[3] or "" for r in turns if r[2] == "assistant"]
        out[conv] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), sum(map(len, said)), sha("".join(said)))
    return out


@pytest.mark.parametrize("n_parts", [1, 6])
def test_digests_agree_with_the_plain_way(spark, n_parts):
    r = random.Random(5)
    some = lambda: "".join(r.choice(BITS) for _ in range(r.randrange(9)))
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole|"]), r.choice([None, some(), some()])) for c in range(60) for t in range(r.randrange(1, 7))]
    # One conversation has a third of all rows; some rows have no conversation.
    rows += [(99, t, r.choice(["user", "assistant"]), some()) for t in range(5000)] + [(None, t, "assistant", "x") for t in range(3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(n_parts)
    made = format_turns(df.withColumn("content", text_part(F.col("text"))))
    got = conversation_digests(made).collect()
    assert {g["conv_id"]: (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) for g in got} == plain(rows)
    assert len(got) == 62
    total = made.agg(F.sum(F.length("formatted"))).first()[0]
    assert sum(g["formatted_chars"] for g in got) == total


def test_repeated_turns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    digest = lambda rows: conversation_digests(format_turns(spark.createDataFrame(rows, schema).withColumn("content", text_part(F.col("text"))))).collect()
    assert digest([]) == []
    twice = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first")]
    (got,) = digest(twice)
    assert (got["n_turns"], got["turns_sha256"]) == (3, sha("assistant\nfirst\nuser\na\nuser\na\n"))
    long = "<|" * 400_000
    (got,) = digest([(1, 0, "assistant", long)])
    assert (got["loss_chars"], got["loss_sha256"], got["formatted_chars"]) == (len(long), sha(long), len(long) + 400_000 + len("<|im_start|>assistant\n<|im_end|>\n"))
