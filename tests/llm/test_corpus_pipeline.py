"""The pipeline stage by stage against plain versions of each, on the small tables."""

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillfin.session import checkpoint_dir
from tests.llm.test_countmin import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after every stage, written and read as the pipeline does."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (None, docs.first()["text"], "en", "src1", 5)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema)).unionAll(docs.limit(2)).checkpoint()
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_columns_stay(stages):
    for name in ("quality_rules", "near_dedup", "substring_dedup", "mixing"):
        assert stages[name].columns == stages["documents"].columns
        assert stages[name].count() > 0


def test_quality_rules_drop_failures_and_keep_clean_documents(spark, stages):
    kept = Counter(r["doc_id"] for r in stages["quality_rules"].collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in stages["documents"].collect():
        w = words(r["text"])
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        fails = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        if fails:
            assert r["doc_id"] not in kept
        elif labels.get(r["doc_id"]) == 1:
            assert kept[r["doc_id"]]


def test_near_dedup_keeps_one_of_each_group(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["quality_rules"].where("doc_id is not null").collect()]
    after = Counter(r["doc_id"] for r in stages["near_dedup"].where("doc_id is not null").collect())
    assert set(after.values()) == {1}
    sets = {i: shingles(t) for i, t in before}
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    for i in sets:
        same = {j for j in near[i] if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert i in after or any(j < i for j in near[i])
        assert not (i in after and any(j in after for j in same))
    # Rows without an id stay as they are.
    assert stages["near_dedup"].where("doc_id is null").count() == stages["quality_rules"].where("doc_id is null").count()


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, b), (1, a), (1, b), (2, c), (2, a + " more"), (3, c), (3, c), (4, "alone " + b[:0] + " ".join(f"d{i}" for i in range(30)))]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate([*rows, (4, rows[-1][1]), (None, b)])], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_dedup(spark, docs.repartition(4), SF).collect())
    assert got == sorted([("0", b), ("1", a), ("2", c), ("4", rows[-1][1]), ("None", b)])


def test_substring_dedup_against_all_windows(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["near_dedup"].collect()]
    got = sorted((str(r["doc_id"]), " ".join(words(r["text"]))) for r in stages["substring_dedup"].collect())
    assert got == sorted((str(i), kept) for i, _, _, kept in brute(before))
    for r in stages["substring_dedup"].where("doc_id is not null and text is not null").collect():
        assert r["n_chars"] == len(r["text"])


def test_mixing_repeats_documents_towards_the_targets(stages):
    before = Counter((r["doc_id"], r["text"]) for r in stages["substring_dedup"].collect())
    after = Counter((r["doc_id"], r["text"]) for r in stages["mixing"].collect())
    assert all(n <= 3 * before[k] for k, n in after.items()) and set(after) <= set(before)
    assert after != before


def test_packing_of_what_is_left(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in stages["mixing"].collect():
        tokens[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    packed, sequences = Counter(), {}
    for r in stages["packing"].collect():
        packed[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert packed == tokens
    for pieces in sequences.values():
        filled = 0
        for at, n in sorted(pieces):
            assert at == filled
            filled += n
        assert filled <= 2048


def test_run_and_empty_documents(spark, tmp_path):
    checkpoint_dir(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    few = docs.where(F.col("doc_id") < 40)
    few.write.mode("overwrite").parquet(str(tmp_path / "few" / "documents.parquet"))
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    path = str(tmp_path / "few")
    assert key(corpus_pipeline.run(spark, path)) == key(corpus_pipeline.run(spark, path)) != []
