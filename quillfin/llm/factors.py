"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Words go to ``BUCKETS`` features by hash, with the square root of their share as value; each statistic
goes to the one of its quantile bins that holds it, with value 1. The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairwise interactions at the cost of one pass over the features. It is fitted on a bounded sample by
stochastic gradients with adaptive rates; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.llm.samples import SAMPLE_ROWS, labelled
from quillfin.llm.words import rows_in_steps, utf8, words

BUCKETS = 1 << 12
RANK = 8
BINS = 16
EPOCHS, BATCH, STEP, DECAY = 12, 64, 0.1, 1e-4
THRESHOLD = 0.3

STATISTICS = (
    "n_words n_bytes word_length capitals digits marks bangs signs bars wide_bytes line_length equal_neighbours distinct_share "
    "equal_line_heads short_words long_words"
).split()

_KINDS = np.zeros((7, 256), bool)
_KINDS[0, 65:91], _KINDS[1, 48:58] = True, True
_KINDS[2, list(b".,;:'\"-()")], _KINDS[3, list(b"!?")] = True, True
_KINDS[4, list(b"#*$%&<>@^~_=+{}[]\\/")], _KINDS[5, list(b"|")] = True, True
_KINDS[6, 0x80:] = True


@dataclass(frozen=True)
class Sparse:
    """Features of some texts: text ``i`` has ``index`` and ``value`` from ``first[i]`` to ``first[i + 1]``."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray


def word_features(texts: pa.Array) -> tuple[Sparse, np.ndarray]:
    """Hashed words and structure statistics of the texts of one step."""
    w = words(texts, lower=True)
    rows, n, owner = len(texts), w.counts, w.owner()
    h = w.hashes(np.arange(len(w.start)), np.ones(len(w.start), np.int64))
    cell, count = np.unique(owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    text, index = cell // BUCKETS, cell % BUCKETS
    sparse = Sparse(np.searchsorted(text, np.arange(rows + 1)), index, np.sqrt(count / np.maximum(n, 1)[text]))

    raw, offsets = utf8(texts)
    text_of = np.repeat(np.arange(rows), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    kinds = [np.bincount(text_of[k[raw]], minlength=rows) / size for k in _KINDS]
    some = np.maximum(n, 1)
    length = w.end - w.start
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    distinct = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(h)]
    lines = np.bincount(text_of[raw == 10], minlength=rows) + 1
    share = lambda which, of=owner: np.bincount(of[which], minlength=rows) / some
    heads = _line_heads(raw, w.at, owner)
    head = h[heads]
    by = np.lexsort((head, owner[heads]))
    again = np.append(False, (head[by][1:] == head[by][:-1]) & (owner[heads][by][1:] == owner[heads][by][:-1]))[: len(by)]
    columns = [
        np.log1p(n), np.log1p(np.diff(offsets)), np.bincount(owner, length, rows) / some, *kinds, np.log1p(n / lines),
        share(np.flatnonzero(same) + 1), np.bincount(owner[order][distinct], minlength=rows) / some,
        np.bincount(owner[heads][by][again], minlength=rows) / lines, share(length <= 2), share(length >= 12),
    ]
    return sparse, np.stack(columns, 1)


def _line_heads(raw: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words that are the first of a line: only white space with a line feed, or nothing, is before them."""
    if not len(at):
        return np.zeros(0, np.int64)
    feeds = np.append(0, np.cumsum(raw == 10))
    before = feeds[at]
    return np.flatnonzero(np.append(True, (before[1:] > before[:-1]) | (owner[1:] != owner[:-1])))


@dataclass(frozen=True)
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    # Quantile bounds of each statistic.
    bounds: list[np.ndarray]

    def joined(self, words_: Sparse, statistics: np.ndarray) -> Sparse:
        """Words and the bins of the statistics as one set of features."""
        return joined(words_, statistics, self.bounds)

    def raw(self, x: Sparse) -> np.ndarray:
        return self.w0 + _sums(x, self.w[x.index] * x.value) + _pairs(x, self.v)[0]

    def score(self, texts: pa.Array, metadata: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for begin, end in rows_in_steps(texts):
            words_, statistics = word_features(texts.slice(begin, end - begin))
            x = self.joined(words_, np.concatenate([statistics, metadata[begin:end]], 1))
            out[begin:end] = 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))
        return out


def joined(words_: Sparse, statistics: np.ndarray, bounds: list[np.ndarray]) -> Sparse:
    rows, k = statistics.shape
    bins = np.stack([np.searchsorted(b, statistics[:, j]) for j, b in enumerate(bounds)], 1) if k else np.zeros((rows, 0), int)
    index = BUCKETS + np.arange(k) * BINS + bins
    n = np.diff(words_.first)
    first = words_.first + k * np.arange(rows + 1)
    out, value = np.empty(first[-1], np.int64), np.ones(first[-1])
    at = np.arange(len(words_.index)) + k * np.repeat(np.arange(rows), n)
    out[at], value[at] = words_.index, words_.value
    own = (first[1:, None] - k + np.arange(k)).ravel()
    out[own] = index.ravel()
    return Sparse(first, out, value)


def _sums(x: Sparse, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    rows = len(x.first) - 1
    text = np.repeat(np.arange(rows), np.diff(x.first))
    if values.ndim == 1:
        return np.bincount(text, values, rows)
    return np.stack([np.bincount(text, c, rows) for c in values.T], 1)


def _pairs(x: Sparse, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half of (square of sum - sum of squares); the sums; and each feature's v times x."""
    vx = v[x.index] * x.value[:, None]
    total = _sums(x, vx)
    return 0.5 * (total**2 - _sums(x, vx**2)).sum(1), total, vx


def fit(x: Sparse, y: np.ndarray, bounds: list[np.ndarray], epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss by mini-batches with AdaGrad; the same result on each run."""
    size = BUCKETS + len(bounds) * BINS
    r = np.random.default_rng(seed)
    rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    w0, w, v = float(np.log(rate / (1 - rate))), np.zeros(size), r.normal(0, 0.02, (size, RANK))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    for _ in range(epochs if len(y) else 0):
        order = r.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            take = np.concatenate([np.arange(x.first[i], x.first[i + 1]) for i in rows])
            b = Sparse(np.append(0, np.cumsum(np.diff(x.first)[rows])), x.index[take], x.value[take])
            pairs, total, vx = _pairs(b, v)
            p = 1 / (1 + np.exp(-np.clip(w0 + _sums(b, w[b.index] * b.value) + pairs, -30, 30)))
            e = (p - y[rows]) / len(rows)
            text = np.repeat(np.arange(len(rows)), np.diff(b.first))
            used, local = np.unique(b.index, return_inverse=True)
            ex = e[text] * b.value
            dw = np.bincount(local, ex, len(used)) + DECAY * w[used]
            slope = ex[:, None] * (total[text] - vx)
            dv = np.stack([np.bincount(local, c, len(used)) for c in slope.T], 1) + DECAY * v[used]
            g0, gw[used], gv[used] = g0 + e.sum() ** 2, gw[used] + dw**2, gv[used] + dv**2
            w0 -= STEP * e.sum() / np.sqrt(g0)
            w[used] -= STEP * dw / np.sqrt(gw[used])
            v[used] -= STEP * dv / np.sqrt(gv[used])
    return Machine(w0, w, v, bounds)


def _metadata(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Numeric columns as the logarithm of their size, null as -1."""
    columns = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]
    known = [np.where(np.isnan(c), -1.0, np.log1p(np.maximum(np.nan_to_num(c), 0))) for c in columns]
    return np.stack(known, 1) if known else np.zeros((batch.num_rows, 0))


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", allowed: Column | None = None, metadata: Sequence[str] = (), rows: int = SAMPLE_ROWS
) -> Machine:
    """A machine from up to ``rows`` labelled documents that ``allowed`` (over ``labels``) permits.
    ``metadata`` names numeric columns of ``docs``. Without any labelled row all scores are a half."""
    names = list(metadata)
    sample = labelled(docs.select("doc_id", "text", *names), labels, label_col, allowed, rows)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _metadata(batch, names)
            for begin, end in rows_in_steps(batch.column("text")):
                part = batch.slice(begin, end - begin)
                x, s = word_features(part.column("text"))
                s = np.concatenate([s, extra[begin:end]], 1)
                cuts = list(zip(x.first[:-1], x.first[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in s], pa.binary()),
                        pa.array([x.index[a:b].astype(np.int32).tobytes() for a, b in cuts], pa.binary()),
                        pa.array([x.value[a:b].astype(np.float32).tobytes() for a, b in cuts], pa.binary()),
                    ],
                    ["doc_id", "label", "statistics", "index", "value"],
                )

    got = (
        sample.select("doc_id", "label", "text", *names)
        .mapInArrow(extracted, "doc_id long, label int, statistics binary, index binary, value binary")
        .collect()
    )
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in got], float)
    statistics = np.array([np.frombuffer(r["statistics"]) for r in got]).reshape(len(got), len(STATISTICS) + len(names))
    bounds = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if len(c) else np.zeros(0) for c in statistics.T]
    index = [np.frombuffer(r["index"], np.int32) for r in got]
    value = [np.frombuffer(r["value"], np.float32) for r in got]
    first = np.append(0, np.cumsum([len(i) for i in index])).astype(np.int64)
    whole = Sparse(first, np.concatenate(index or [np.zeros(0, np.int32)]).astype(np.int64), np.concatenate(value or [np.zeros(0, np.float32)]).astype(float))
    if not len(y):
        return Machine(0.0, np.zeros(BUCKETS + len(bounds) * BINS), np.zeros((BUCKETS + len(bounds) * BINS, RANK)), bounds)
    return fit(joined(whole, statistics, bounds), y, bounds)


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Null and empty texts are scored by their statistics alone. Columns with these names are replaced.
    """
    new = {"score": "double", "predicted": "int"}
    names = list(metadata)
    rest = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{n} {t}" for n, t in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = machine.score(batch.column(text_col), _metadata(batch, names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, *new])

    return rest.mapInArrow(run, schema)
