"""Late-interaction scoring: score(doc) = sum over query tokens of max over doc tokens of <q, t>.

The query batch is small and the corpus is not, so queries travel and documents stay: each task
multiplies the query matrix with its own Arrow batches of documents and keeps only its local best
``k`` per query, and a per-query top-k over those few rows gives the result. The query matrix is
shipped only while its measured size is under ``max_query_bytes``; larger batches are cut into blocks
of queries, read and scored one after the other (one corpus pass each), and a single query beyond the
bound is cut into blocks of tokens whose scores add up. Pairs of a query and a document are shuffled
only for such a query, and by ``maxsim_scores``, whose result they are.

Scores are accumulated in float64 and compared at ``SCORE_DECIMALS`` decimals, ties broken by
``segment_id``, so the order does not depend on summation order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.models.embed import Embedder, to_arrow_multivectors
from quillfin.session import checkpoint_dir

SCORE_DECIMALS = 6
MAX_QUERY_BYTES = 64 << 20
_PROBE_TOKENS = 8192
_TILE_CELLS = 1 << 20  # similarity cells of one tile (8 MB of float64, near the cache size)
_BATCH_CELLS = 8 << 20  # scores or maxima a task holds before passing them on
_STEP_CHARS = 1 << 18  # text embedded at a time, whose vectors are tens of times its size


def segment_max(cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Column maxima of the row segments beginning at ``starts`` (one vectorised pass per segment)."""
    out = np.empty((len(starts), cells.shape[1]), dtype=cells.dtype)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(cells)])):
        cells[a:b].max(axis=0, out=out[i])
    return out


class QueryBatch:
    """Query tokens of one block: unique token rows plus how often each query uses them."""

    def __init__(self, ids: list[str], token_query: np.ndarray, tokens: np.ndarray) -> None:
        self.ids = ids
        if len(tokens):
            self.tokens, inverse = np.unique(tokens, axis=0, return_inverse=True)
        else:
            self.tokens, inverse = tokens, np.zeros(0, dtype=np.int64)
        self.tokens32 = self.tokens.astype(np.float32)
        pairs, counts = np.unique(np.stack([token_query, inverse.ravel()], axis=1), axis=0, return_counts=True)
        self.use_query, self.use_token, self.use_count = pairs[:, 0], pairs[:, 1], counts.astype(np.float64)
        self.present, starts = np.unique(self.use_query, return_index=True)
        self.use_starts = starts
        self.use_ends = np.append(starts[1:], len(self.use_query))
        self._total_uses = np.zeros(len(ids))
        np.add.at(self._total_uses, self.use_query, self.use_count)
        self._longest = float(np.sqrt((self.tokens**2).sum(axis=1)).max()) if len(tokens) else 0.0

    def scores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(n_queries, n_docs) scores of the documents whose tokens start at ``starts``, in ``flat``'s precision."""
        out = np.zeros((len(self.ids), len(starts)))
        if not len(self.tokens) or not len(starts):
            return out
        mine = self.tokens32 if flat.dtype == np.float32 else self.tokens
        best = segment_max(flat @ mine.T, starts)
        out[self.present] = np.add.reduceat(best[:, self.use_token] * self.use_count, self.use_starts, axis=1).T
        return out

    def exact(self, q: int, doc: np.ndarray) -> float:
        """Score of one pair in float64."""
        at = int(np.searchsorted(self.present, q))
        if at == len(self.present) or self.present[at] != q:
            return 0.0
        used = slice(self.use_starts[at], self.use_ends[at])
        best = (self.tokens[self.use_token[used]] @ doc.astype(np.float64).T).max(axis=1)
        return float(np.round((best * self.use_count[used]).sum(), SCORE_DECIMALS))

    def slack(self, flat: np.ndarray) -> np.ndarray:
        """Per query: how far a float32 score can be from the rounded exact one."""
        dim = flat.shape[1]
        longest = float(np.sqrt(np.einsum("ij,ij->i", flat, flat).max())) if len(flat) else 0.0
        unit = 2.0**-23 * (dim + 3) * self._longest * longest
        return self._total_uses * unit * 1.01 + 10.0**-SCORE_DECIMALS


def _read_block(rows: DataFrame) -> QueryBatch:
    """Bring one size-checked block of query tokens (query_id, v) to the driver for broadcasting."""
    return _as_block(rows.select("query_id", "v").toArrow())


def _as_block(table: pa.Table) -> QueryBatch:
    ids, code = np.unique(np.asarray(table["query_id"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    values = table["v"].combine_chunks()
    dim = len(values[0]) if len(values) else 0
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), dim)
    return QueryBatch(list(ids), code.ravel(), flat)


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, qi, v): one row per query token."""
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"), F.posexplode("vectors").alias("qi", "v")
    )


def _blocks(tokens: DataFrame, max_bytes: int) -> Iterator[tuple[bool, QueryBatch]]:
    """Blocks of query tokens, one after the other: ``True`` with whole queries, ``False`` with a slice of
    the tokens of an oversized one. The caller needs no more than one of them at a time."""
    # A batch of few tokens is read and measured in one job.
    probe = tokens.select("query_id", "v").limit(_PROBE_TOKENS + 1).toArrow()
    if probe.num_rows <= _PROBE_TOKENS and probe["v"].nbytes * 2 <= max_bytes:
        yield True, _as_block(probe)
        return
    size = F.sum(F.size("v") * 8)
    total = tokens.agg(size.alias("b")).first()["b"] or 0
    if total <= max_bytes:
        yield True, _read_block(tokens)
        return
    # Read once for each block, so no model embeds a query twice.
    checkpoint_dir(tokens.sparkSession)
    tokens = tokens.checkpoint()
    n = int(-(-2 * total // max_bytes))
    placed = tokens.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    # One row per block: a few numbers, however many queries there are.
    sizes = (
        placed.groupBy("block", "query_id").agg(size.alias("b"))
        .groupBy("block").agg(F.sum("b").alias("b"), F.max("b").alias("largest"), F.count("*").alias("n"))
        .collect()
    )
    for r in sizes:
        part = placed.where(F.col("block") == r["block"])
        if r["b"] <= max_bytes:
            yield True, _read_block(part)
        elif r["largest"] <= max_bytes and r["n"] > 1:
            # Unlucky hash block: rehash just this block until every piece fits.
            m = 2 * int(r["n"])
            for j in range(m):
                piece = part.where(F.pmod(F.hash("query_id", F.lit(r["block"])), F.lit(m)) == j)
                yield from ((whole, b) for whole, b in _blocks(piece, max_bytes) if b.ids)
        else:
            m = int(-(-2 * r["b"] // max_bytes))
            for j in range(m):
                block = _read_block(part.where(F.pmod(F.hash("query_id", "qi"), F.lit(m)) == j))
                if block.ids:
                    yield False, block


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers with tokens, token starts, token counts, flat float64 tokens) of one Arrow batch."""
    outer = batch.column("vectors")
    offsets = outer.offsets.to_numpy()
    counts = np.diff(offsets)
    rows = np.flatnonzero((counts > 0) & outer.is_valid().to_numpy(zero_copy_only=False))
    inner = outer.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    flat = flat.reshape(len(inner), -1) if len(inner) else np.zeros((0, 1))
    kept = counts[rows]
    return rows, np.cumsum(kept, dtype=np.int64) - kept, kept, flat


def _tiles(starts: np.ndarray, counts: np.ndarray, n_query_tokens: int) -> Iterator[tuple[int, int]]:
    """Document ranges whose similarity matrix fits the tile budget (one document at least)."""
    budget = max(1, _TILE_CELLS // max(1, n_query_tokens))
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts + counts, starts[lo] + budget, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def _score_batch(block: QueryBatch, batch: pa.RecordBatch, precision: type) -> Iterator[tuple]:
    """(row numbers, scores, slack, tokens of a document) for groups of documents that have tokens."""
    rows, starts, counts, stored = _documents(batch)
    flat = stored.astype(precision, copy=False)
    waiting: list[np.ndarray] = []
    begin = 0
    for lo, hi in _tiles(starts, counts, len(block.tokens)):
        a, b = starts[lo], starts[hi - 1] + counts[hi - 1]
        waiting.append(block.scores(flat[a:b], starts[lo:hi] - a))
        if (hi - begin) * len(block.ids) > _BATCH_CELLS or hi == len(rows):
            first = begin
            slack = block.slack(flat[starts[first] : b])
            yield rows[first:hi], np.concatenate(waiting, axis=1), slack, (
                lambda i: stored[starts[first + i] : starts[first + i] + counts[first + i]]
            )
            waiting, begin = [], hi


class _Leaders:
    """Best ``k`` groups of one query seen by a task, ordered by (score desc, segment_id asc)."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.best: dict[str, tuple[float, str]] = {}
        # The same entries in order, so that the worst is at the end.
        self.order: list[tuple[tuple[float, str], str]] = []
        self.floor = -np.inf

    def candidates(self, approximate: np.ndarray, slack: float, groups: list[str]) -> np.ndarray:
        """Documents that could enter, best first; the rest is beaten by k groups beyond the slack."""
        open_to = np.flatnonzero(approximate >= self.floor - slack)
        open_to = open_to[np.argsort(-approximate[open_to], kind="stable")]
        seen: set[str] = set()
        for n, i in enumerate(open_to):
            seen.add(groups[i])
            if len(seen) >= self.k:
                cut = approximate[i] - 2 * slack
                return open_to[: n + 1 + int(np.count_nonzero(approximate[open_to[n + 1 :]] >= cut))]
        return open_to

    def offer(self, score: float, segment: str, group: str) -> None:
        entry = (-score, segment)
        held = self.best.get(group)
        if held is not None:
            if entry >= held:
                return
            del self.order[bisect_left(self.order, (held, group))]
        elif len(self.best) == self.k:
            if entry >= self.order[-1][0]:
                return
            del self.best[self.order.pop()[1]]
        self.best[group] = entry
        insort(self.order, (entry, group))
        if len(self.best) == self.k:
            self.floor = -self.order[-1][0][0]


_SCORE_SCHEMA = "query_id string, segment_id string, group_id string, score double"


def _local_topk(block: QueryBatch, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = [_Leaders(k) for _ in block.ids]
        for batch in batches:
            segments = batch.column("segment_id").to_pylist()
            groups = batch.column("group_id").to_pylist()
            # float32 finds who could matter, float64 decides.
            for rows, scores, slack, tokens in _score_batch(block, batch, np.float32):
                grp = [groups[i] for i in rows]
                floors = np.array([lead.floor for lead in leaders])
                for q in np.flatnonzero(scores.max(axis=1) >= floors - slack):
                    for i in leaders[q].candidates(scores[q], slack[q], grp):
                        leaders[q].offer(block.exact(q, tokens(i)), segments[rows[i]], grp[i])
        found = [(qid, seg, grp, -neg) for qid, lead in zip(block.ids, leaders) for grp, (neg, seg) in lead.best.items()]
        for at in range(0, len(found), 50_000):
            part = list(zip(*found[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0]), pa.array(part[1]), pa.array(part[2]), pa.array(part[3], pa.float64())],
                names=["query_id", "segment_id", "group_id", "score"],
            )

    return run


def _all_scores(block: QueryBatch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, scores, _, _ in _score_batch(block, batch, np.float64):
                at = pa.array(rows)
                seg, grp = batch.column("segment_id").take(at), batch.column("group_id").take(at)
                for q, qid in enumerate(block.ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([qid] * len(rows), pa.string()), seg, grp, pa.array(scores[q])],
                        names=["query_id", "segment_id", "group_id", "score"],
                    )

    return run


def _scorable(points: DataFrame, group: str | None, content: str) -> DataFrame:
    group_id = F.col("segment_id") if group is None else F.coalesce(F.nullif(F.col(group), F.lit("")), F.col("segment_id"))
    return points.select("segment_id", group_id.alias("group_id"), content)


def _embedding(run, model: Embedder):
    """``run`` over batches of text: embedded next to the scoring, so vectors never leave the worker."""

    def to_vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        # Only this step's vectors are held, however many rows and bytes Spark puts in a batch.
        found = model.embed_texts([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("segment_id"), batch.column("group_id"), to_arrow_multivectors(found, model.dim)],
            names=["segment_id", "group_id", "vectors"],
        )

    return lambda batches: run(to_vectors(s) for b in batches for s in _text_steps(b))


def _text_steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``_STEP_CHARS`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP_CHARS, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def maxsim_topk(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    group: str | None = None,
    max_query_bytes: int = MAX_QUERY_BYTES,
    text_model: Embedder | None = None,
) -> DataFrame:
    """Best ``k`` points per query: ``(query_id, rank, segment_id, score)``.

    ``points`` has ``segment_id string`` and ``vectors``; filters and anti-joins belong before this
    call so that dropped points are never scored. With ``group`` (a column such as ``chunk_id``) each
    group is represented by its best point before the cut; a null or empty group stands for itself.
    With ``text_model`` the points carry ``text`` that has not been embedded yet instead of vectors.
    """
    corpus = _scorable(points, group, "text" if text_model else "vectors")

    def over_corpus(run) -> DataFrame:
        return corpus.mapInArrow(_embedding(run, text_model) if text_model else run, _SCORE_SCHEMA)

    found: list[DataFrame] = []
    pieces: list[DataFrame] = []
    for whole, result in _each_block(queries, max_query_bytes, lambda whole, b: over_corpus(_local_topk(b, k) if whole else _all_scores(b))):
        (found if whole else pieces).append(result)
    if pieces:
        found.append(
            reduce(DataFrame.unionByName, pieces)
            .groupBy("query_id", "segment_id", "group_id")
            .agg(F.round(F.sum("score"), SCORE_DECIMALS).alias("score"))
        )
    return best(reduce(DataFrame.unionByName, found), group, k)


def best(scored: DataFrame, group: str | None, k: int) -> DataFrame:
    """The best ``k`` of ``(query_id, segment_id, group_id, score)`` for each query, one point for each group."""
    if group is not None:
        scored = scored.groupBy("query_id", "group_id").agg(
            F.min(F.struct((-F.col("score")).alias("neg"), "segment_id")).alias("b")
        ).select("query_id", "b.segment_id", (-F.col("b.neg")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "segment_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "segment_id", "score")
    )


def _each_block(queries: DataFrame, max_bytes: int, score) -> Iterator[tuple[bool, DataFrame]]:
    """``score(whole, block)`` of every block. A single one stays lazy; of several, each is scored and its
    result written before the next is read, so that the driver holds one."""
    blocks = _blocks(query_tokens(queries), max_bytes)
    whole, block = next(blocks)
    second = next(blocks, None)
    if second is None:
        yield whole, score(whole, block)
        return
    checkpoint_dir(queries.sparkSession)
    yield whole, score(whole, block).checkpoint()
    whole, block = second
    while True:
        yield whole, score(whole, block).checkpoint()
        try:
            whole, block = next(blocks)
        except StopIteration:
            return


_PARTIAL_SCHEMA = "query_id string, qi int, doc_id string, best double"


def maxsim_scores(tokens: DataFrame, queries: DataFrame, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """Score of every document for every query from exploded tokens ``(doc_id string, v array<float>)``.

    A document may be spread over any number of tasks, and may hold any share of the rows: each task
    reduces its batches to one maximum per (query token, document) before the shuffle.
    """
    number = count()
    pieces = [
        piece
        for _, piece in _each_block(
            queries, max_query_bytes,
            lambda _, block: tokens.select("doc_id", "v").mapInArrow(_token_maxima(block, next(number)), _PARTIAL_SCHEMA),
        )
    ]
    best = reduce(DataFrame.unionByName, pieces).groupBy("query_id", "qi", "doc_id").agg(F.max("best").alias("best"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.sum("best"), SCORE_DECIMALS).alias("score"))


def _token_maxima(block: QueryBatch, part: int):
    """Per-batch maxima. ``qi`` numbers (query, unique token) uses so that blocks never collide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(held), pa.string())
            best = np.stack(list(held.values()), axis=1)
            for u in range(len(block.use_query)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.ids[block.use_query[u]]] * len(names), pa.string()),
                        pa.array(np.full(len(names), (part << 20) + u, dtype=np.int32)),
                        names,
                        pa.array(best[block.use_token[u]] * block.use_count[u]),
                    ],
                    names=["query_id", "qi", "doc_id", "best"],
                )

        for batch in batches:
            if not batch.num_rows or not block.ids:
                continue
            docs, code = np.unique(np.asarray(batch.column("doc_id").to_pylist(), dtype=object).astype(str), return_inverse=True)
            order = np.argsort(code, kind="stable")
            values = batch.column("v")
            flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)[order].astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(docs)))[:-1]])
            step = max(1, _TILE_CELLS // max(1, len(block.tokens)))
            for lo in range(0, len(flat), step):
                piece = flat[lo : lo + step]
                first = int(np.searchsorted(starts, lo, side="right")) - 1
                inside = starts[(starts > lo) & (starts < lo + len(piece))] - lo
                cuts = np.concatenate([[0], inside]).astype(np.int64)
                best = segment_max(piece @ block.tokens.T, cuts)
                for j in range(len(cuts)):
                    name = str(docs[first + j])
                    old = held.get(name)
                    held[name] = best[j] if old is None else np.maximum(old, best[j])
            # Bounded memory: a task over many documents hands its maxima to the shuffle early.
            if len(held) * max(1, len(block.tokens)) > _BATCH_CELLS:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return run
