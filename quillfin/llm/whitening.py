"""Embedding whitening: principal components of all vectors, refined from float32 to double precision.

Entries are put on an integer grid first, ``x = floor(64 * entry) + 1000000``, so sums, counts and
deviations are exact. The fit list is every distinct grid vector once. Two passes over it give the exact
sums and then the covariance of vectors that are centred before they are multiplied; tasks add up their
own products and Spark sums those, so the driver gets one ``d x d`` matrix, however many rows there are.

Its eigenvectors are found in float32 and corrected by matrix products in extended precision, after
Ogita and Aishima: with ``R = I - X'X`` and ``S = X'AX``, ``X + XE`` is a better basis, where ``E`` follows
from ``R`` and ``S`` entry by entry and the error is squared by each step. Where two eigenvalues are closer
than the error of the step, their quotient says nothing; such a cluster is solved by itself, as a small
problem shifted to its own middle, so that the differences inside it are all that is left to see.

Result rows are projected where they lie, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.session import checkpoint_dir

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
MAX_STEPS = 60
# Grid values are held inside this, so that they and their sums stay exact.
_MOST = float(1 << 52)
_SPLIT = 20
NEW = ["whitened", "deviation"]


@dataclass(frozen=True)
class Whitening:
    """What the rows are projected on. ``vectors`` has a unit component in each row, by falling ``values``."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def usable(vector: Column) -> Column:
    """Whether the vector is not null and all its entries are finite numbers."""
    # A difference with itself is zero for finite numbers only.
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double") - v.cast("double")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def grid(vector: Column) -> Column:
    """``floor(64 * entry) + 1000000`` of each entry as a long; beyond 2^52 it stays at that."""
    scaled = lambda v: F.greatest(F.least(v.cast("double") * SCALE, F.lit(_MOST)), F.lit(-_MOST))
    return F.transform(vector, lambda v: F.floor(scaled(v)).cast("long") + F.lit(SHIFT).cast("long"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """How many grid vectors there are, and the sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            rows += len(x)
            high += (x >> _SPLIT).sum(axis=0)
            low += (x & ((1 << _SPLIT) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, rows)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = fit.mapInArrow(partial, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low"))
    by_dim = {r["i"]: r for r in found.collect()}
    sums = tuple((int(by_dim[i]["high"]) << _SPLIT) + int(by_dim[i]["low"]) for i in range(dim))
    return by_dim[0]["n"], sums


def _centred(x: np.ndarray, middle: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``x - S/n`` in double precision: the whole part of ``S/n`` is taken away exactly, then the rest."""
    return (x - middle).astype(np.float64) - rest


def _mean(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    middle = [s // n for s in sums]
    return np.array(middle, np.int64), np.array([(s - m * n) / n for s, m in zip(sums, middle)])


def _covariance(fit: DataFrame, dim: int, n: int, sums: tuple[int, ...], axes: np.ndarray | None = None) -> np.ndarray:
    """Covariance, with divisor ``n``, of the centred grid vectors, projected on ``axes`` if given.

    A task sums the products of its vectors around its own mean; how far the means of tasks lie apart is
    added from their sums. The triangle of ``d (d + 1) / 2`` sums per task is what is shuffled.
    """
    middle, rest = _mean(n, sums)
    width = dim if axes is None else axes.shape[1]
    upper_i, upper_j = (a.astype(np.int32) for a in np.triu_indices(width))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mean, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), dim), middle, rest)
            if not len(y):
                continue
            y = y if axes is None else y @ axes
            own = y.mean(axis=0)
            y = y - own
            step = own - mean
            products += y.T @ y + np.outer(step, step) * (rows * len(y) / (rows + len(y)))
            mean = mean + step * (len(y) / (rows + len(y)))
            rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper_i), pa.array(upper_j), pa.array(products[upper_i, upper_j]), pa.array(mean[upper_i] * rows), pa.array(mean[upper_j] * rows), pa.array(mean[upper_i] * mean[upper_j] * rows)],
                ["i", "j", "product", "si", "sj", "sij"],
            )

    sums_of = [F.sum(c).alias(c) for c in ("product", "si", "sj", "sij")]
    found = fit.mapInArrow(partial, "i int, j int, product double, si double, sj double, sij double").groupBy("i", "j").agg(*sums_of)
    out = np.zeros((width, width))
    for r in found.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (r["product"] + r["sij"] - r["si"] * r["sj"] / n) / n
    return out


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other at ``near`` or less, for two and more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(a: np.ndarray, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of the symmetric matrix ``a``."""
    d = len(a)
    size = float(np.abs(a).max()) if d else 0.0
    if size == 0.0:
        return np.zeros(d), np.eye(d)
    wide = a.astype(np.longdouble) / np.longdouble(size)
    start = (wide.astype(np.float64)).astype(np.float32)
    x = np.linalg.eigh(start)[1].astype(np.longdouble)
    one, norm = np.eye(d, dtype=np.longdouble), float(np.linalg.norm(wide.astype(np.float64), 2))
    least, last, solved = float(np.finfo(np.longdouble).eps) * 8, np.inf, False
    for _ in range(max_steps):
        r = one - x.T @ x
        s = x.T @ (wide @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = (s - np.diag(values)).astype(np.float64)
        near = 2 * (float(np.linalg.norm(off, 2)) + norm * float(np.linalg.norm(r.astype(np.float64), 2)))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > near
        e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        moved = float(np.abs(e).max())
        for cluster in _clusters(values, near):
            # The rest is orthogonal to the cluster by now, so the turn inside it can be found alone.
            own = x[:, cluster]
            inner = own.T @ (wide @ own) - values[cluster].mean() * (own.T @ own)
            spread = np.abs(inner).max()
            if spread > least * norm:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float64))[1]
                x[:, cluster] = own @ turn.astype(np.longdouble)
        # Squared errors end at the last digits; from there on steps only move those.
        if moved <= least or (solved and moved >= last / 2):
            break
        solved, last = moved < 1e-9, moved
    # Turns inside clusters are orthogonal to double precision only.
    x = x + x @ (one - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (wide @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * np.longdouble(size)
    # One sign for all runs: the largest entry is positive.
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None, :], 0) < 0, -1, 1)
    return values.astype(np.float64), x.astype(np.float64)


def _projection(vectors: np.ndarray, values: np.ndarray, trace: float) -> np.ndarray:
    """Axes in columns, divided by ``sqrt(e)``; those without variance are zero."""
    some = values > max(trace, 0.0) * len(vectors) * np.finfo(np.float64).eps
    return vectors * np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)


def _dimension(ready: DataFrame) -> int:
    """The length that most vectors have; of equals, the largest."""
    found = ready.groupBy(F.size("_x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return found["dim"] if found else 0


def _delete(df: DataFrame, folder: str) -> None:
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def gridded(df: DataFrame, vector_col: str) -> DataFrame:
    """Usable rows with their grid vector as ``_x``, those of the most frequent length."""
    ready = df.drop("_x").where(usable(F.col(vector_col))).withColumn("_x", grid(F.col(vector_col)))
    return ready.where(F.size("_x") == _dimension(ready))


def learn(ready: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of ``gridded`` rows; ``None`` if there are no rows or no dimensions.

    The distinct vectors are written once to the shared folder, read by three passes and deleted. What
    the driver holds is bounded by the square of the dimension.
    """
    spark = ready.sparkSession
    folder = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4()}"
    ready.select("_x").distinct().write.parquet(folder)
    try:
        fit = spark.read.parquet(folder)
        first = fit.first()
        dim = len(first["_x"]) if first else 0
        if not dim:
            return None
        n, sums = _exact_sums(fit, dim)
        v = _covariance(fit, dim, n, sums)
        values, vectors = refined(v)
        trace, k = float(np.trace(v)), min(components, dim)
        axes = _projection(vectors[:, :k], values[:k], trace)
        error = np.abs(_covariance(fit, dim, n, sums, axes) - np.eye(k)).max()
        return Whitening(n, sums, vectors[:, :k].T.copy(), values[:k], trace, float(error))
    finally:
        _delete(ready, folder)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...], middle: np.ndarray) -> list[int]:
    """``sum((n * x - S) ** 2)`` of each row, exact: as Python integers where longs could overflow."""
    near, left = x - middle, [s - n * int(m) for s, m in zip(sums, middle)]
    most = n * (int(np.abs(near).max()) + 1) if len(x) else 0
    if most * most * len(sums) < 1 << 62:
        return ((n * near - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - r) ** 2 for v, r in zip(row, left)) for row in near]


def whiten(ready: DataFrame, model: Whitening) -> DataFrame:
    """Columns of ``gridded`` rows plus ``whitened`` (array<double>, one entry a component) and ``deviation``
    (decimal(38,0), null beyond 38 digits). ``ready`` must be what the model has learned from, or rows of
    the same dimension; columns with the names of the new ones are replaced.
    """
    ready = ready.drop(*NEW)
    dim, k = len(model.sums), len(model.values)
    middle, rest = _mean(model.n, model.sums)
    axes = _projection(model.vectors.T, model.values, model.trace)
    n, sums = model.n, model.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.names.index("_x")), dim)
            white = _centred(x, middle, rest) @ axes
            offsets = np.arange(len(x) + 1, dtype=np.int32) * k
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))
            texts = pa.array([str(d) for d in _deviations(x, n, sums, middle)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], [*batch.schema.names, "whitened", "_deviation"])

    schema = T.StructType([*ready.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("_deviation", T.StringType())])
    exact = F.when(F.length("_deviation") <= 38, F.col("_deviation").cast("decimal(38,0)")).alias("deviation")
    return ready.mapInArrow(project, schema).select(*[F.col(c) for c in ready.columns if c != "_x"], "whitened", exact)


def components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``df`` and component: ``id_col``, ``component`` from 1, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out, and so are vectors of
    another length than most. Equal vectors, and rows with the same or no id, each keep their row. A
    component without variance has ``whitened`` and ``explained`` zero, and its missing variance counts in
    ``identity_error``. Without rows or dimensions the result is empty. ``deviation`` is null where it
    exceeds a long.
    """
    ready = gridded(df.select(F.col(id_col), F.col(vector_col)), vector_col).select(id_col, "_x")
    model = learn(ready, k)
    if model is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], T.StructType([df.schema[id_col], *T._parse_datatype_string(schema).fields]))
    long_rows = whiten(ready, model).select(id_col, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    share = F.array(*[F.lit(e) for e in model.explained])
    return long_rows.select(
        id_col,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as long)").alias("deviation"),
        "whitened",
        F.element_at(share, F.col("_at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
