"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing and packing of ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.llm import balance, ballhash, countmin, divergence, grouping
from quillfin.session import checkpoint_dir, ship_package

# Near copies are judged on runs of this many words.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return divergence.judge(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, of texts with that id in the group
    the one with the smallest hash, and of equal rows one.

    Rows without an id can't be named by another one and stay.
    """
    found = ballhash.similar_documents(docs.where("doc_id is not null"), shingle=SHINGLE)
    stay = found.where("first").groupBy("doc_id", F.col("text_key").alias("_key")).agg(F.count("*").alias("_rows")).checkpoint()
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    once = keyed.join(stay.where("_rows = 1"), ["doc_id", "_key"], "left_semi").select(*docs.columns)
    # Rows with the same id and text; their number may be any, so they are combined before they are shuffled.
    rest = [c for c in docs.columns if c != "doc_id"]
    several = keyed.join(stay.where("_rows > 1"), ["doc_id", "_key"], "left_semi").groupBy("doc_id", "_key").agg(F.min(F.struct(*rest)).alias("_row"))
    picked = several.select("doc_id", "_row.*").select(*docs.columns)
    return once.unionAll(picked).unionAll(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has, too."""
    cut = countmin.drop_repeated(docs)
    text = F.col("kept_text").alias("text")
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")}
    return cut.select(*[changed.get(c, F.col(c)) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = balance.mixed(docs.withColumn("_words", balance.word_count(F.col("text"))), size_col="_words")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_copy", times).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    import public_tokenizers

    return grouping.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# No stage but the mix could be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    ship_package(spark)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
