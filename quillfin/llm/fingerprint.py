"""Document fingerprints by one-permutation MinHash.

Each 5-word shingle is hashed once; the hash picks one of ``BINS`` bins and a value, and a bin keeps its
least value. Empty bins are filled by optimal densification: bin ``i`` asks the bins that a fixed random
sequence of its own names, until one is filled, and takes that value. Only the low bits of each value are
kept, packed; two texts agree in a bin by chance with probability ``2^-BITS``, which the estimate of
their Jaccard similarity removes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.words import mixed, rows_in_steps, words
from quillfin.session import checkpoint_dir

BINS = 512
BITS = 2
SHINGLE = 5
# Bins asked in each bin's sequence before the nearest filled one is taken; with one filled bin in 512
# this leaves a bin to that rule once in e^16.
ASKED = 8192
# Text bytes of a range partition.
PARTITION_BYTES = 16 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _asked(bins: int) -> np.ndarray:
    """The bins that each bin asks, by turn: a fixed random table."""
    i = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(ASKED) + np.arange(ASKED, dtype=np.uint64)
    return (mixed(i + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int16)


_ASKED: dict[int, np.ndarray] = {}


def signatures(texts: pa.Array, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> np.ndarray:
    """The low-order bits of every bin, one row of ``bins`` small numbers per text.

    A text of fewer words than a shingle is one shingle; a wordless text has no values and gets zeros.
    """
    out = np.zeros((len(texts), bins), np.uint8)
    for begin, end in rows_in_steps(texts):
        w = words(texts.slice(begin, end - begin))
        first, count, bounds = w.runs(shingle, whole_if_shorter=True)
        h = mixed(w.hashes(first, count))
        text = np.repeat(np.arange(end - begin), np.diff(bounds))
        least = np.full((end - begin) * bins, _NONE)
        # The upper half picks the bin, the whole is the value.
        np.minimum.at(least, text * bins + ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64), mixed(h) >> np.uint64(1))
        least = least.reshape(-1, bins)
        some = np.flatnonzero(np.diff(bounds))
        # The bin is mixed in, so that copies of one value in several bins keep independent low bits.
        value = mixed(_densified(least[some], bins) ^ (np.arange(bins, dtype=np.uint64) << np.uint64(48)))
        out[begin + some] = (value & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return out


def _densified(least: np.ndarray, bins: int) -> np.ndarray:
    """Fills empty bins; each row has at least one value."""
    if bins not in _ASKED:
        _ASKED[bins] = _asked(bins)
    asked, filled, out = _ASKED[bins], least != _NONE, least.copy()
    row, at = np.nonzero(~filled)
    for turn in range(ASKED):
        if not len(row):
            return out
        donor = asked[at, turn]
        hit = filled[row, donor]
        out[row[hit], at[hit]] = least[row[hit], donor[hit]]
        row, at = row[~hit], at[~hit]
    for r, i in zip(row, at):
        near = np.flatnonzero(filled[r])
        out[r, i] = least[r, near[np.searchsorted(near, i) % len(near)]]
    return out


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each row's values as bytes, ``bits`` (1, 2, 4 or 8) to a value."""
    spread = (values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(spread.reshape(len(values), -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity per row, 0 to 1; two wordless texts are alike, one and a text are not."""
    chance = 1 / (1 << bits)
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), found)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter of its code points replaced by
    as many of the first of the next text in ascending order of ids (the last row's next is the first).

    ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null
    texts are empty. Null ids come first; rows with equal ids are ordered by the hash of their texts. A
    single row is its own next. Other columns are ignored.

    Rows are range-partitioned by id, so neighbours meet in one task without a global sort. The first and
    last text of each partition are passed on to be joined with those of the neighbouring partitions.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(size // PARTITION_BYTES) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    results = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _along(batches, bins, bits, shingle)

    done = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(pairs, f"{results}, tie long, end string, text string")
        .checkpoint()
    )
    inner = done.where("end is null").drop("tie", "end", "text")
    tails = done.where("end = 'last'").select("id", "tie", "text")
    heads = done.where("end = 'first'").select("id", "tie", "text")
    # One key per range partition: which head follows which tail.
    key = lambda r: (r["id"] is not None, r["id"] or 0, r["tie"])
    before = sorted(tails.select("id", "tie").collect(), key=key)
    after = sorted(heads.select("id", "tie").collect(), key=key)
    follows = [(i, b["id"], b["tie"], a["id"], a["tie"]) for i, (b, a) in enumerate(zip(before, after[1:] + after[:1]))]
    links = spark.createDataFrame(follows, "nth int, id long, tie long, next_id long, next_tie long") if follows else None
    if links is None:
        return inner.withColumnRenamed("id", id_col)
    ends = (
        links.join(tails, links["id"].eqNullSafe(tails["id"]) & (links["tie"] == tails["tie"]))
        .select("nth", links["id"], tails["text"], "next_id", "next_tie")
        .dropDuplicates(["nth"])
    )
    nexts = heads.select(F.col("id").alias("head_id"), F.col("tie").alias("head_tie"), F.col("text").alias("next_text")).dropDuplicates(["head_id", "head_tie"])
    joined = ends.join(nexts, F.col("next_id").eqNullSafe(F.col("head_id")) & (F.col("next_tie") == F.col("head_tie")))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _compared(batch.column(0), batch.column(1), batch.column(2), bins, bits, shingle)

    outer = joined.select("id", "text", "next_text").mapInArrow(last, results)
    return inner.unionAll(outer).withColumnRenamed("id", id_col)


def _along(batches: Iterator[pa.RecordBatch], bins: int, bits: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but the last; the first and the last as they are."""
    previous: pa.RecordBatch | None = None
    for batch in batches:
        for begin, end in rows_in_steps(batch.column(1)):
            part = batch.slice(begin, end - begin)
            if previous is None:
                yield _end(part.slice(0, 1), "first")
                run = part
            else:
                run = pa.Table.from_batches([previous, part]).combine_chunks().to_batches()[0]
            if run.num_rows > 1:
                n = run.num_rows - 1
                found = _compared(run.column(0).slice(0, n), run.column(1).slice(0, n), run.column(1).slice(1, n), bins, bits, shingle)
                nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([*found.columns, *nothing], [*found.schema.names, "tie", "end", "text"])
            previous = run.slice(run.num_rows - 1, 1)
    if previous is not None:
        yield _end(previous, "last")


_RESULTS = {
    "id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}


def _end(row: pa.RecordBatch, which: str) -> pa.RecordBatch:
    empty = [pa.nulls(1, t) for n, t in _RESULTS.items() if n != "id"]
    return pa.RecordBatch.from_arrays([row.column(0), *empty, row.column(2), pa.array([which]), row.column(1)], [*_RESULTS, "tie", "end", "text"])


def _compared(ids: pa.Array, texts: pa.Array, nexts: pa.Array, bins: int, bits: int, shingle: int) -> pa.RecordBatch:
    plain, following = texts.to_pylist(), nexts.to_pylist()
    edited = [edit(t, n) for t, n in zip(plain, following)]
    changed = pa.array(edited, pa.string())
    own, other = (signatures(x, bins, bits, shingle) for x in (texts, changed))
    # The next text of each row but the last is the next row's own, if the rows are neighbours.
    if len(ids) > 1 and plain[1:] == following[:-1]:
        later = np.concatenate([own[1:], signatures(nexts.slice(len(ids) - 1), bins, bits, shingle)])
    else:
        later = signatures(nexts, bins, bits, shingle)
    none, none_edited, none_next = (np.array([not t or not t.strip(" \t\n\x0b\x0c\r") for t in x], bool) for x in (plain, edited, following))
    columns = [
        ids, [len(t) for t in plain], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [x.tobytes().hex() for x in packed(own, bits)], [x.tobytes().hex() for x in packed(other, bits)],
        likeness(own, other, bits, none, none_edited), likeness(own, later, bits, none, none_next),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULTS.values())], list(_RESULTS))


def edit(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many code points of the next text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]
