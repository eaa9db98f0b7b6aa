"""Exact MaxSim top-k that leaves out blocks of points which cannot reach the best ``k``.

``write_blocks`` lays points out once: every point goes to the cell of the centre nearest to its mean token,
and the points of a cell are cut into blocks of some thousand tokens. The first row of a block carries a few
balls that hold all its tokens, so a scan of that one column knows what any query can find in the block: a
token ``t`` in a ball of centre ``c`` and radius ``r`` has ``<q, t> <= <q, c> + |q| r``.

``pruned_topk`` scores the blocks with the highest bounds first, takes the score of the k-th best point found
as a floor, and then reads the blocks whose bound reaches it. Cells are folders, so those without such a block
are not opened. Bounds only decide what is read: the rows are those of ``maxsim_topk`` over all points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.operators import maxsim
from quillfin.operators.maxsim import MAX_QUERY_BYTES, QueryBatch
from quillfin.session import checkpoint_dir

CELLS = 256
BLOCK_TOKENS = 4096
BALLS = 8
# Points scored for the floor, at least; the floor of a query needs k groups among them.
SEED_POINTS = 256
# Up to so many blocks to visit are broadcast (24 bytes each); beyond, only cells are left out.
MAX_VISITED = 1_000_000

_BALLS = "array<struct<centre: array<double>, radius: double>>"


def write_blocks(points: DataFrame, folder: str, cells: int = CELLS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``points`` (``segment_id``, one row each, ``vectors`` and any other columns) to ``folder`` in blocks;
    the table that was written.

    Centres are the mean tokens of as many points as the root of their number, up to ``cells``, the first by a
    hash of their ids; the sample decides how well blocks can be left out, never which points are found. Points without tokens go to cell -1: nothing
    scores them. A cell may hold any share of the points, as ranges of (cell, hash of the id) share it out.
    Columns named ``cell``, ``block``, ``points`` or ``balls`` are replaced.
    """
    new = ("cell", "block", "points", "balls")
    rows = points.select(*[c for c in points.columns if c not in new])
    order = F.xxhash64("segment_id")
    full = rows.where(F.size("vectors") > 0).select("segment_id", "vectors")
    sample = full.orderBy(order, "segment_id").limit(min(cells, int(full.count() ** 0.5) + 1))
    centres = np.array([np.mean(np.array(r["vectors"], float), axis=0) for r in sample.collect()])
    at = rows.columns.index("vectors")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            own, starts, counts, flat = maxsim._documents(batch.select(["vectors"]))
            if len(own):
                mean = np.add.reduceat(flat.astype(float), starts, axis=0) / counts[:, None]
                cell[own] = ((centres**2).sum(1) - 2 * mean @ centres.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            size = np.diff(batch.column(at).offsets.to_numpy())
            block, first = np.zeros(len(cell), np.int64), []
            room = 0
            for i in range(len(cell)):
                if not i or cell[i] != cell[i - 1] or size[i] > room:
                    number, room = number + 1, block_tokens
                    first.append(i)
                block[i], room = number, room - size[i]
            ends = [*first[1:], len(cell)]
            balls: list = [None] * len(cell)
            held: list = [None] * len(cell)
            for a, b in zip(first, ends):
                tokens = maxsim._documents(batch.slice(a, b - a).select(["vectors"]))[3].astype(float)
                balls[a], held[a] = _balls(tokens) if size[a:b].sum() else [], b - a
            kind = pa.list_(pa.struct([("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(block), pa.array(held, pa.int32()), pa.array(balls, kind)], [*batch.schema.names, *new[1:]]
            )

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"
    placed = rows.mapInArrow(nearest, shape)
    ranged = placed.repartitionByRange(F.col("cell"), order).sortWithinPartitions("cell", order)
    made = ranged.mapInArrow(blocks, f"{shape}, block long, points int, balls {_BALLS}")
    made.write.partitionBy("cell").parquet(folder)
    return points.sparkSession.read.schema(made.schema).parquet(folder)


def _balls(tokens: np.ndarray) -> list[dict]:
    """A few balls that hold all ``tokens``: centres far from each other, moved to the mean of what is nearest."""
    centres = tokens[:1]
    apart = ((tokens - centres[0]) ** 2).sum(1)
    while len(centres) < BALLS and apart.max() > 0:
        centres = np.vstack([centres, tokens[apart.argmax()]])
        apart = np.minimum(apart, ((tokens - centres[-1]) ** 2).sum(1))
    near = ((centres**2).sum(1) - 2 * tokens @ centres.T).argmin(1)
    out = []
    for ball in np.unique(near):
        own = tokens[near == ball]
        centre = own.mean(0)
        out.append({"centre": centre, "radius": float(np.sqrt(((own - centre) ** 2).sum(1).max()))})
    return out


def _bounds(block: QueryBatch, balls: pa.Array) -> np.ndarray:
    """(queries, blocks): what no document of a block can exceed; minus infinity for one without tokens."""
    out = np.full((len(block.ids), len(balls)), -np.inf)
    offsets = balls.offsets.to_numpy()
    inner = balls.flatten()
    own = np.flatnonzero(np.diff(offsets) > 0)
    if not len(own) or not len(block.tokens):
        out[:, own] = 0.0
        return out
    centre = inner.field("centre").flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1)
    radius = inner.field("radius").to_numpy()
    long = np.sqrt((block.tokens**2).sum(1))
    # A margin for the rounding of these products.
    reach = radius + 1e-9 * (radius + np.sqrt((centre**2).sum(1)))
    best = np.maximum.reduceat(centre @ block.tokens.T + reach[:, None] * long, offsets[own] - offsets[0], axis=0)
    summed = np.zeros((len(own), len(block.ids)))
    summed[:, block.present] = np.add.reduceat(best[:, block.use_token] * block.use_count, block.use_starts, axis=1)
    out[:, own] = summed.T
    return out


def _best_blocks(block: QueryBatch, seed_points: int):
    """For each query the blocks of a task with the highest bounds, until they hold ``seed_points``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, int, int, int]]] = [[] for _ in block.ids]
        for batch in batches:
            found = _bounds(block, batch.column("balls"))
            names = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "points"))))
            for q, row in enumerate(found):
                mine = sorted([*held[q], *((-row[i], *names[i]) for i in np.flatnonzero(~np.isneginf(row)))])
                passed = np.cumsum([m[3] for m in mine])
                held[q] = mine[: int(np.searchsorted(passed, seed_points)) + 1]
        rows = [(qid, -m[0], m[1], m[2], m[3]) for qid, own in zip(block.ids, held) for m in own]
        if rows:
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["query_id", "bound", "cell", "block", "points"])

    return run


def _reaching(block: QueryBatch, floors: np.ndarray):
    """Blocks that may hold a point of a query's best ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _bounds(block, batch.column("balls"))
            below = (found < floors[:, None]) | np.isneginf(found)
            yield batch.select(["cell", "block", "points"]).filter(pa.array(~below.all(axis=0)))

    return run


@dataclass(frozen=True)
class Pruned:
    """``result`` as of ``maxsim_topk``; ``visited`` of ``blocks`` blocks were read, summed over blocks of queries."""

    result: DataFrame
    blocks: int
    visited: int


def pruned_topk(
    points: DataFrame, queries: DataFrame, k: int, group: str | None = None, max_query_bytes: int = MAX_QUERY_BYTES, seed_points: int = SEED_POINTS
) -> Pruned:
    """Best ``k`` points per query of ``points``, the table that ``write_blocks`` wrote.

    Filters on points belong before this call, except that they must keep the rows with ``balls``: filter
    ``points`` by a column ``live`` instead, and rows where it is not true are read for their balls only.
    Tokens of a single query beyond ``max_query_bytes`` have no bound together; such a query visits all blocks.
    """
    checkpoint_dir(points.sparkSession)
    bounds = points.where("balls is not null").select("cell", "block", "points", "balls")
    live = points.where("live") if "live" in points.columns else points
    found, pieces, blocks, visited = [], [], 0, 0
    several = maxsim._blocks(maxsim.query_tokens(queries), max_query_bytes)
    for whole, block in several:
        if not whole:
            pieces.append(maxsim._scorable(live, group, "vectors").mapInArrow(maxsim._all_scores(block), maxsim._SCORE_SCHEMA).checkpoint())
            continue
        score = lambda some, block=block: maxsim.best(maxsim._scorable(some, group, "vectors").mapInArrow(maxsim._local_topk(block, k), maxsim._SCORE_SCHEMA), group, k)
        falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        seeds = bounds.mapInArrow(_best_blocks(block, max(seed_points, 4 * k)), "query_id string, bound double, cell int, block long, points int")
        before = F.coalesce(F.sum("points").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = seeds.withColumn("before", before).where(F.col("before") < max(seed_points, 4 * k)).select("cell", "block").distinct()
        kth = {r["query_id"]: r["score"] for r in score(_visiting(live, seeds.checkpoint())).where(F.col("rank") == k).collect()}
        floors = np.array([kth.get(q, -np.inf) for q in block.ids]) - 10.0**-maxsim.SCORE_DECIMALS
        open_to = bounds.mapInArrow(_reaching(block, floors), "cell int, block long, points int").checkpoint()
        blocks, visited = blocks + bounds.where(F.size("balls") > 0).count(), visited + open_to.count()
        found.append(score(_visiting(live, open_to)).checkpoint())
    if pieces:
        summed = reduce(DataFrame.unionByName, pieces).groupBy("query_id", "segment_id", "group_id").agg(F.round(F.sum("score"), maxsim.SCORE_DECIMALS).alias("score"))
        found.append(maxsim.best(summed, group, k))
    return Pruned(reduce(DataFrame.unionByName, found), blocks, visited)


def _visiting(points: DataFrame, some: DataFrame) -> DataFrame:
    """The points of ``some`` blocks, from the folders of their cells only."""
    cells = [r["cell"] for r in some.select("cell").distinct().collect()]
    inside = points.where(F.col("cell").isin(cells) if cells else F.lit(False))
    if some.count() > MAX_VISITED:
        return inside
    return inside.join(F.broadcast(some.select("block")), "block", "left_semi").select(*points.columns)
