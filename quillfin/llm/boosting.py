"""Toxicity by gradient-boosted trees over a few dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, whose documents are toxic far more often than
others (z score of the log odds). Two halves of the sample learn from each other's lexicon, so that a word
that is only by chance in toxic documents doesn't look reliable, and each half's raw scores come from the
other's trees, so that calibration sees what unseen documents get. All learning is on a bounded sample;
scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.llm.samples import SAMPLE_ROWS, labelled
from quillfin.llm.words import SPACE, rows_in_steps, utf8, words, xxh64

# Beginnings of words that may be in the lexicon, in bytes; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
MIN_TOXIC, MIN_Z, LEXICON_TERMS = 3, 3.0, 4_000
NEAR = 5
TREES, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 80, 4, 0.15, 32, 5.0, 1.0

# Words that address the reader.
SECOND_PERSON = (
    "you your yours yourself u ur thou thee tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch euer sie "
    "tú ti vos usted ustedes tuyo vuestro os"
).split()
FEATURES = (
    "log_words word_density stem_density log_word_hits log_stem_hits word_odds stem_odds top_odds near_you_density near_you_hits "
    "you_density capitals shouted_words punctuation exclamations symbols digits obfuscated word_length drawn_out"
).split()


def _plain() -> np.ndarray:
    """Bytes of a text as the lexicon sees them: small letters, digits and signs that stand for letters
    as these, other ASCII signs as spaces."""
    out = np.arange(256, dtype=np.uint8)
    for i in range(0x80):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() else 0x20
    for sign, letter in zip("013457@$", "oieastas"):
        out[ord(sign)] = ord(letter)
    return out


_PLAIN = _plain()
_UPPER, _LOWER, _DIGIT, _SIGN, _MARK, _BANG = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SIGN[list(b"@$*#%&|<>~^_=+")] = True
_MARK[list(b".,;:'\"-()!?")] = True
_BANG[list(b"!?")] = True


@dataclass(frozen=True)
class Lexicon:
    """Hashes and log odds of the terms of each prefix length, in the order of the hashes."""

    terms: dict[int, tuple[np.ndarray, np.ndarray]]

    def odds(self, prefix: int, h: np.ndarray) -> np.ndarray:
        known, odds = self.terms.get(prefix, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(known):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, odds[at], 0.0)


def _terms(texts: pa.Array):
    """The plain words of texts, and per prefix length which words have one and its hash."""
    raw, offsets = utf8(texts)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[raw])])
    w = words(plain)
    size = w.end - w.start
    found = {}
    for prefix in PREFIXES:
        has = np.flatnonzero(size > prefix)
        found[prefix] = has, xxh64(w.data, w.start[has], size[has] if not prefix else np.full(len(has), prefix), prefix)
    return w, found


_YOU = np.sort(xxh64(np.frombuffer("".join(SECOND_PERSON).encode(), np.uint8), np.cumsum([0, *[len(x.encode()) for x in SECOND_PERSON[:-1]]]), np.array([len(x.encode()) for x in SECOND_PERSON])))


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero rates for null and wordless texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for begin, end in rows_in_steps(texts):
        out[begin:end] = _step_features(texts.slice(begin, end - begin), lexicon)
    return out


def _step_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    rows = len(texts)
    w, found = _terms(texts)
    n = np.maximum(w.counts, 1)
    owner = w.owner()
    word_odds = np.zeros(len(w.start))
    stem_odds = np.zeros(len(w.start))
    for prefix, (has, h) in found.items():
        odds = lexicon.odds(prefix, h)
        if prefix:
            stem_odds[has] = np.maximum(stem_odds[has], odds)
        else:
            word_odds[has] = odds
            you = np.zeros(len(w.start), bool)
            you[has] = _YOU[np.minimum(np.searchsorted(_YOU, h), len(_YOU) - 1)] == h
    total = lambda x: np.bincount(owner, x, rows)
    hit = (word_odds > 0) | (stem_odds > 0)
    near = hit & _near(you, owner, NEAR)
    top = np.zeros(rows)
    np.maximum.at(top, owner, np.maximum(word_odds, stem_odds))
    raw, offsets = utf8(texts)
    text_of = np.repeat(np.arange(rows), np.diff(offsets))
    byte = lambda which: np.bincount(text_of[which[raw]], minlength=rows)
    upper, lower = byte(_UPPER), byte(_LOWER)
    size = np.maximum(np.diff(offsets), 1)
    shouted, obfuscated = _odd_words(raw, offsets)
    drawn = np.zeros(rows)
    if len(raw) > 2:
        # Three equal bytes of one text; texts lie end to end here.
        thrice = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (text_of[2:] == text_of[:-2]) & ~SPACE[raw[2:]]
        drawn = np.bincount(text_of[2:][thrice], minlength=rows)
    return np.stack(
        [
            np.log1p(w.counts), total(word_odds > 0) / n, total(stem_odds > 0) / n, np.log1p(total(word_odds > 0)),
            np.log1p(total(stem_odds > 0)), total(word_odds), total(stem_odds), top, total(near) / n, total(near), total(you) / n,
            upper / np.maximum(upper + lower, 1), shouted / n, byte(_MARK) / size, byte(_BANG) / size, byte(_SIGN) / size,
            byte(_DIGIT) / size, obfuscated / n, np.diff(offsets) / n, drawn / size,
        ],
        axis=1,
    )


def _near(mark: np.ndarray, owner: np.ndarray, reach: int) -> np.ndarray:
    """Words with a marked word of the same text at most ``reach`` words away."""
    out = mark.copy()
    for d in range(1, reach + 1):
        same = owner[d:] == owner[:-d]
        out[d:] |= mark[:-d] & same
        out[:-d] |= mark[d:] & same
    return out


def _odd_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the words in capitals only and the words with letters next to digits or signs inside."""
    w = words(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(raw))]))
    rows = len(offsets) - 1
    if not len(w.start):
        return np.zeros(rows), np.zeros(rows)
    upper, lower = (np.add.reduceat(x[w.data], w.start, dtype=np.int64) for x in (_UPPER, _LOWER))
    letter, sign = (_UPPER | _LOWER)[w.data], (_SIGN | _DIGIT)[w.data]
    mixed = np.append(letter[:-1] & sign[1:], False)
    # A sign at the very end of a word hides nothing.
    mixed[w.end - 2] = False
    mixed[:-1] |= sign[:-1] & letter[1:]
    owner = w.owner()
    odd = np.add.reduceat(mixed, w.start, dtype=np.int64) > 0
    return np.bincount(owner, (upper > 1) & (lower == 0), rows), np.bincount(owner, odd, rows)


def lexicons(sample: DataFrame) -> dict[int | None, Lexicon]:
    """Lexicons from labelled texts ``(text, label, fold)``: by fold, from the other fold; by None, from all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in rows_in_steps(batch.column(0)):
                part = batch.slice(begin, end - begin)
                yield _counted(part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy())

    counts = (
        sample.select("text", "label", "fold")
        .mapInArrow(counted, "prefix int, term long, p0 long, n0 long, p1 long, n1 long")
        .groupBy("prefix", "term")
        .agg(*[F.sum(c).alias(c) for c in ("p0", "n0", "p1", "n1")])
    )
    totals = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", "fold").count().collect()}
    size = lambda label, folds: float(sum(totals.get((label, f), 0) for f in folds))
    out = {}
    for fold, folds in ((0, (1,)), (1, (0,)), (None, (0, 1))):
        p, n = (sum(F.col(f"{c}{f}") for f in folds) for c in "pn")
        odds = F.log((p + 0.5) / (F.lit(size(1, folds)) - p + 0.5)) - F.log((n + 0.5) / (F.lit(size(0, folds)) - n + 0.5))
        z = odds / F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        best = counts.where(p >= MIN_TOXIC).select("prefix", "term", odds.alias("odds"), z.alias("z")).where(F.col("z") >= MIN_Z)
        terms: dict[int, list] = {}
        for r in best.orderBy(F.desc("z"), "prefix", "term").limit(LEXICON_TERMS).collect():
            terms.setdefault(r["prefix"], []).append((r["term"] % (1 << 64), r["odds"]))
        out[fold] = Lexicon({k: (np.array([t for t, _ in sorted(v)], np.uint64), np.array([o for _, o in sorted(v)])) for k, v in terms.items()})
    return out


def _counted(texts: pa.Array, label: np.ndarray, fold: np.ndarray) -> pa.RecordBatch:
    """Documents with each term, by label and fold."""
    w, found = _terms(texts)
    owner = w.owner()
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for prefix, (has, h) in found.items():
        order = np.lexsort((h, owner[has]))
        h, doc = h[order], owner[has][order]
        first = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
        term, at = np.unique(h[first], return_inverse=True)
        kind = fold[doc[first]] * 2 + (label[doc[first]] == 0)
        table = np.bincount(at * 4 + kind, minlength=4 * len(term)).reshape(-1, 4)
        for c, x in zip(columns, [np.full(len(term), prefix), term.view(np.int64), *table.T]):
            c.append(x)
    kinds = (pa.int32(), *[pa.int64()] * 5)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], ["prefix", "term", "p0", "n0", "p1", "n1"]
    )


@dataclass
class Trees:
    """Boosted trees of one depth: per tree and inner node a feature and the largest bin that goes left."""

    cuts: list[np.ndarray]
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for (feature, cut), leaf in zip(self.nodes, self.leaves):
            out += leaf[_leaf(b, feature, cut)]
        return out


def _leaf(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(DEPTH):
        at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
    return at - (2**DEPTH - 1)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosting with second-order steps for the logistic loss, over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if len(c) else np.zeros(0) for c in x.T]
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(cuts, float(np.log(rate / (1 - rate))))
    if not len(y):
        return model
    b = model.binned(x)
    f = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        feature, cut, leaf = _grown(b, p - y, p * (1 - p))
        model.nodes.append((feature, cut))
        model.leaves.append(leaf)
        f += leaf[_leaf(b, feature, cut)]
    return model


def _grown(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree, level by level; a node without a gain sends all rows left."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    at = np.zeros(len(b), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best = np.full(width, 1e-6)
        for j in range(b.shape[1]):
            cell = (at - first) * (BINS + 1) + b[:, j]
            gs, hs = (np.bincount(cell, v, width * (BINS + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
            g_all, h_all = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + RIDGE) + (g_all - gs) ** 2 / (h_all - hs + RIDGE) - g_all**2 / (h_all + RIDGE)
            enough = (hs > MIN_LEAF / 4) & (h_all - hs > MIN_LEAF / 4)
            gain = np.where(enough, gain, 0.0)
            k = gain.argmax(1)
            top = gain[np.arange(width), k]
            better = top > best
            best[better] = top[better]
            feature[first : first + width][better], cut[first : first + width][better] = j, k[better]
        at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
    at -= inner
    leaf = -np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
    return feature, cut, RATE * leaf


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing curve from raw scores to rates, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, t in zip(raw[order], y[order].astype(float)):
        blocks.append([r, 1.0, t])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            r2, n2, t2 = blocks.pop()
            r1, n1, t1 = blocks[-1]
            blocks[-1] = [(r1 * n1 + r2 * n2) / (n1 + n2), n1 + n2, t1 + t2]
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    curve: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        raw = self.trees.raw(features(texts, self.lexicon))
        return np.clip(np.interp(raw, *self.curve), 0, 1) if len(self.curve[0]) else np.full(len(raw), 0.5)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", allowed: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """A model from up to ``rows`` labelled documents that ``allowed`` (over ``labels``) permits."""
    sample = labelled(docs.select("doc_id", "text"), labels, label_col, allowed, rows)
    found = lexicons(sample)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            x = np.where((fold == 0)[:, None], features(batch.column(0), found[0]), features(batch.column(0), found[1]))
            rows_ = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), rows_], ["label", "fold", "doc_id", "x"])

    got = sample.select("text", "label", "fold", "doc_id").mapInArrow(extracted, "label int, fold int, doc_id long, x array<double>").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    y, fold = (np.array([r[c] for r in got], int) for c in ("label", "fold"))
    raw = np.zeros(len(y))
    for f in (0, 1):
        raw[fold == f] = fit_trees(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(found[None], fit_trees(x, y), isotonic(raw, y))


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1, higher: likelier toxic) and ``predicted``.

    Null and empty texts have a score like any text without words. Columns with these names are replaced.
    """
    return with_scores(docs, model.score, text_col, threshold)


def with_scores(docs: DataFrame, score, text_col: str, threshold: float) -> DataFrame:
    new = {"score": "double", "predicted": "int"}
    rest = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{n} {t}" for n, t in new.items()])
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(at)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, *new])

    return rest.mapInArrow(run, schema)
