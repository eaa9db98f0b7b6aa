"""Quality rules by distribution divergence.

A text's histograms of character classes and of common words are compared with those of each language of
the corpus, by Jensen-Shannon distance (base 2, so 0 to 1). A text far from every language is rejected.
Short texts have noisy histograms: below a minimum length nothing is compared, above it the limits fall
with the length. The distance that chance alone makes is about the square root of ``k / (8 n ln 2)`` for
``n`` words that hit ``k`` bins, so the limit for words follows that.

References come from all documents, in two passes. A word is common if it makes up a share of at least
``COMMON`` of a language's words. The first pass counts words part by part and sends on those with a share of at
least ``COMMON / FINER`` of a part. What is not sent is less than that share of the language, so a word whose
sum of sent counts is below ``COMMON * (1 - 1 / FINER)`` of the language's words is not common. That is judged in
Spark; at most ``1 / COMMON / (1 - 1 / FINER)`` words of a language (1,111) are left, however its rows are
dealt to parts. They alone reach the driver, and the second pass counts them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.words import Words, chained, mixed, rows_in_steps, utf8, words, xxh64
from quillfin.session import checkpoint_dir

COMMON = 1 / 1000
# A part sends on words down to this fraction of the common share.
FINER = 10
# Languages with fewer words than this have no reference.
MIN_REFERENCE_WORDS = 1_000
# Texts with fewer words than this are not compared.
MIN_WORDS = 50
# Limit for classes: at any length, plus this much over the square root of the number of words.
CLASS_LIMIT = (0.18, 0.8)
# Limit for words, squared: at any length, plus this much for each bin hit by chance and word.
WORD_LIMIT = (0.2**2, 3 / (8 * np.log(2)))
# Fixed rules.
LEAST_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
# Distinct words that one task counts before it decides which are common in its part.
PART_WORDS = 1_000_000

CLASSES = 8


def _classes() -> np.ndarray:
    """Class of each first byte of a character; continuation bytes get a class of their own."""
    out = np.full(256, 6)
    out[[0x20, *range(0x09, 0x0E)]] = 3
    out[ord("0") : ord("9") + 1] = 2
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("a") : ord("z") + 1] = 0
    out[[*b".,;:'\"-()"]] = 4
    out[[*b"!?"]] = 5
    out[0x80:] = CLASSES
    out[0xC0:] = 7
    return out


_CLASS = _classes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Reference:
    """Shares of one language; ``words`` are the hashes of its common words, in order, and ``word_shares``
    ends with the share of all other words."""

    lang: str
    class_shares: np.ndarray
    words: np.ndarray
    word_shares: np.ndarray


@dataclass
class _Count:
    n: int = 0
    classes: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    parts: list = field(default_factory=list)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: float = COMMON) -> list[Reference]:
    """Histograms of every language of ``docs``, over all their whole texts; rows without one are left out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    first = rows.mapInArrow(lambda batches: _first_pass(batches, common / FINER), "lang string, word long, n long, classes array<long>")
    # Rows with a word are candidates; those without carry the counts of a part.
    summed = first.groupBy("lang", "word").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)]
    )
    checkpoint_dir(docs.sparkSession)
    summed = summed.checkpoint()
    large = summed.where(F.col("word").isNull() & (F.col("n") >= MIN_REFERENCE_WORDS))
    totals = {r["lang"]: r for r in large.collect()}
    candidates = {lang: np.zeros(0, np.uint64) for lang in totals}
    near = _near_common(summed, common).groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("words"))
    for r in near.collect():
        candidates[r["lang"]] = np.sort(np.array(r["words"], np.int64).view(np.uint64))
    counted = rows.mapInArrow(lambda batches: _second_pass(batches, candidates), "lang string, word long, n long")
    exact: dict[str, list] = {lang: [] for lang in totals}
    for r in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        if r["n"] >= common * totals[r["lang"]]["n"]:
            exact[r["lang"]].append((r["word"] % (1 << 64), r["n"]))
    out = []
    for lang in sorted(totals):
        n = totals[lang]["n"]
        found = sorted(exact[lang])
        counts = np.array([c for _, c in found] + [n - sum(c for _, c in found)], float)
        classes = np.array([totals[lang][f"c{i}"] for i in range(CLASSES)], float)
        out.append(Reference(lang, classes / classes.sum(), np.array([w for w, _ in found], np.uint64), counts / n))
    return out


def _near_common(summed: DataFrame, common: float) -> DataFrame:
    """``(lang, word)`` of the words that may be common, from the sums of what parts sent: a bounded number a language."""
    whole = summed.where(F.col("word").isNull() & (F.col("n") >= MIN_REFERENCE_WORDS)).select("lang", F.col("n").alias("all"))
    # Rounding must not lose a word that just reaches the share.
    least = F.col("all") * F.lit(common * (1 - 1 / FINER) * (1 - 1e-9))
    return summed.where(F.col("word").isNotNull()).join(whole, "lang").where(F.col("n") >= least).select("lang", "word")


def _word_hashes(w: Words) -> np.ndarray:
    return w.hashes(np.arange(len(w.start)), np.ones(len(w.start), np.int64))


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        codes = lang.indices.to_numpy()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(np.flatnonzero(codes == code)))
            for begin, end in rows_in_steps(texts):
                yield name, texts.slice(begin, end - begin)


def _first_pass(batches: Iterator[pa.RecordBatch], common: float) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Count] = {}
    size = 0

    def part() -> pa.RecordBatch:
        rows = []
        for lang, c in held.items():
            rows.append((lang, None, c.n, c.classes.tolist()))
            if c.parts:
                h, at = np.unique(np.concatenate([p[0] for p in c.parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in c.parts])).astype(np.int64)
                rows += [(lang, int(x), int(k), None) for x, k in zip(h.view(np.int64)[n >= common * c.n], n[n >= common * c.n])]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "word", "n", "classes"])

    for lang, texts in _by_lang(batches):
        c = held.setdefault(lang, _Count())
        w = words(texts)
        c.n += len(w.start)
        c.classes += np.bincount(_CLASS[utf8(texts)[0]], minlength=CLASSES + 1)[:CLASSES]
        if len(w.start):
            c.parts.append(np.unique(_word_hashes(w), return_counts=True))
            size += len(c.parts[-1][0])
        if size > PART_WORDS:
            yield part()
            held, size = {}, 0
    if held:
        yield part()


def _second_pass(batches: Iterator[pa.RecordBatch], candidates: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    counts = {lang: np.zeros(len(c) + 1, np.int64) for lang, c in candidates.items()}
    for lang, texts in _by_lang(batches):
        if lang in counts:
            counts[lang] += np.bincount(_slots(_word_hashes(words(texts)), candidates[lang]), minlength=len(counts[lang]))
    rows = [(lang, int(w), int(n)) for lang, c in candidates.items() for w, n in zip(c.view(np.int64), counts[lang]) if n]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["lang", "word", "n"])


def _slots(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position of each hash among the known ones; their number for all others."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance between each row of ``p`` and ``q``, both of shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", reference: list[Reference] | None = None) -> DataFrame:
    """All columns of ``docs`` plus the verdict and what it rests on.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``: fewer than 20
    words, or over 30 % of them in 8-word windows found twice or more in the text. ``class_distance`` and
    ``word_distance`` (to the nearest language; null if not compared), ``kept``. Null and empty texts have
    zero words and fail. A row's own language doesn't matter, so a wrong or missing one does no harm;
    without any reference nothing is compared. Columns with these names are replaced.
    """
    known = references(docs, text_col, lang_col) if reference is None else reference
    new = {
        "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
        "base_failed": "boolean", "class_distance": "double", "word_distance": "double", "kept": "boolean",
    }
    rest = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{n} {t}" for n, t in new.items()])
    at = rest.columns.index(text_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in rows_in_steps(batch.column(at)):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *_verdicts(part.column(at), known)], [*part.schema.names, *new])

    return rest.mapInArrow(judged, schema)


def _verdicts(texts: pa.Array, known: list[Reference]) -> list[pa.Array]:
    w = words(texts)
    raw, offsets = utf8(texts)
    n, rows = w.counts, len(texts)
    text_of = np.repeat(np.arange(rows), np.diff(offsets))
    classes = np.bincount(text_of * (CLASSES + 1) + _CLASS[raw], minlength=rows * (CLASSES + 1)).reshape(rows, -1)[:, :CLASSES]
    word_chars = classes.sum(1) - classes[:, 3]
    symbols = np.bincount(text_of[_SYMBOL[raw]], minlength=rows)
    hashes = _word_hashes(w)
    repeats = _repeat_words(w, hashes)
    failed = (n < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
    class_distance, word_distance, excess = (np.full(rows, np.nan) for _ in range(3))
    judged = np.flatnonzero(n >= MIN_WORDS) if known else np.zeros(0, int)
    if len(judged):
        shares = classes[judged] / classes[judged].sum(1, keepdims=True)
        class_distance[judged] = np.min([js_distance(shares, r.class_shares) for r in known], 0)
        owner = w.owner()
        nearest, over = [], []
        for r in known:
            width = len(r.words) + 1
            counts = np.bincount(owner * width + _slots(hashes, r.words), minlength=rows * width).reshape(rows, width)[judged]
            nearest.append(js_distance(counts / n[judged][:, None], r.word_shares))
            hit = np.minimum(n[judged][:, None] * r.word_shares, 1).sum(1)
            over.append(nearest[-1] - np.sqrt(WORD_LIMIT[0] + WORD_LIMIT[1] * hit / n[judged]))
        word_distance[judged] = np.min(nearest, 0)
        excess[judged] = np.min(over, 0)
    far = (class_distance > CLASS_LIMIT[0] + CLASS_LIMIT[1] / np.sqrt(np.maximum(n, 1))) | (excess > 0)
    longs = [pa.array(x.astype(np.int64)) for x in (n, word_chars, symbols, _duplicate_lines(raw, offsets, w), repeats)]
    distances = [pa.array(x, mask=np.isnan(x)) for x in (class_distance, word_distance)]
    return [*longs, pa.array(failed), *distances, pa.array(~failed & ~far)]


def _duplicate_lines(raw: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    rows = len(offsets) - 1
    cut = np.flatnonzero(raw == 10)
    # A text of any length has one line more than it has line feeds.
    text_of_cut = np.searchsorted(offsets, cut, side="right") - 1
    begin = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    per_text = np.bincount(text_of_cut, minlength=rows) + 1
    text = np.repeat(np.arange(rows), per_text)
    # A line feed at the end of a text opens an empty line that begins where the next text does.
    last = np.cumsum(per_text) - 1
    end = np.append(begin[1:] - 1, 0)
    end[last] = offsets[1:]
    solid = np.searchsorted(w.at, begin) < np.searchsorted(w.at, end)
    begin, end, text = begin[solid], end[solid], text[solid]
    key = _within(xxh64(raw, begin, end - begin), text)
    order = np.lexsort((key, text))
    same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][same], minlength=rows)


def _within(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that tell equal values of different texts apart."""
    return mixed(h + mixed(text.astype(np.uint64) + np.uint64(1)))


def _repeat_words(w: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words in windows that are found twice or more in it."""
    first, _, bounds = w.runs(REPEAT_WINDOW)
    change = np.zeros(len(w.start) + 1, np.int64)
    if len(first):
        text = np.repeat(np.arange(len(w.first) - 1), np.diff(bounds))
        key = _within(chained(hashes, REPEAT_WINDOW)[first], text)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = first[order[np.append(False, same) | np.append(same, False)]]
        change[twice] += 1
        change[twice + REPEAT_WINDOW] -= 1
    total = np.append(0, np.cumsum(np.cumsum(change)[:-1] > 0))
    return total[w.first[1:]] - total[w.first[:-1]]
