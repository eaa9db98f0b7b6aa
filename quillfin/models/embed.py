"""Embedders: text in, one ragged multivector (tokens x dim) out.

A model is any object with ``dim``, ``embed_texts(list[str]) -> list[ndarray]`` and
``embed_queries(list[str]) -> list[ndarray]``. It is pickled once per task, so it should load its
weights lazily in the worker. ``HashEmbedder`` is the offline default: a lexical stand-in that maps
each word to a fixed pseudo-random unit vector, not a semantic model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
VECTORS = T.ArrayType(T.ArrayType(T.FloatType()))


class Embedder(Protocol):
    dim: int

    def embed_texts(self, texts: list[str]) -> list[np.ndarray]: ...

    def embed_queries(self, texts: list[str]) -> list[np.ndarray]: ...


class HashEmbedder:
    """Each lower-cased word becomes the unit vector of its MD5 hex digits (32 dimensions)."""

    dim = 32

    def __init__(self, cache_words: int = 200_000) -> None:
        self.cache_words = cache_words
        self._row: dict[str, int] = {}
        self._table = np.zeros((0, self.dim), dtype=np.float32)

    def __reduce__(self):
        return HashEmbedder, (self.cache_words,)

    def _vectors(self, words: list[str]) -> np.ndarray:
        """One row per word; unseen words of a batch are hashed and normalised together."""
        fresh = [w for w in dict.fromkeys(words) if w not in self._row]
        if len(self._row) + len(fresh) > self.cache_words:
            self._row, self._table = {}, self._table[:0]
            fresh = list(dict.fromkeys(words))
        if fresh:
            raw = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in fresh), dtype=np.uint8)
            digits = np.stack([raw >> 4, raw & 15], axis=1).reshape(-1, self.dim) - 7.5
            unit = digits / np.sqrt((digits * digits).sum(axis=1, keepdims=True))
            self._row.update(zip(fresh, range(len(self._row), len(self._row) + len(fresh))))
            self._table = np.concatenate([self._table, unit.astype(np.float32)])
        return self._table[[self._row[w] for w in words]]

    def _embed(self, words: list[list[str]]) -> list[np.ndarray]:
        flat = self._vectors([w for ws in words for w in ws])
        return np.split(flat, np.cumsum([len(ws) for ws in words])[:-1]) if words else []

    def embed_texts(self, texts: list[str]) -> list[np.ndarray]:
        # A repeated word cannot change a maximum, so each word is kept once.
        return self._embed([list(dict.fromkeys(WORD.findall(t.lower()))) for t in texts])

    def embed_queries(self, texts: list[str]) -> list[np.ndarray]:
        # Every occurrence counts: the score sums over query tokens.
        return self._embed([WORD.findall(t.lower()) for t in texts])


def _joined(parts: list[np.ndarray | None]) -> np.ndarray | None:
    if any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def to_arrow_multivectors(vectors: list[np.ndarray | None], dim: int) -> pa.Array:
    """Ragged (tokens x dim) matrices as one Arrow ``list<list<float>>`` without a Python loop per value."""
    missing = np.array([v is None for v in vectors], bool)
    vectors = [np.zeros((0, dim), dtype=np.float32) if v is None else v for v in vectors]
    lengths = np.fromiter((len(v) for v in vectors), dtype=np.int64, count=len(vectors))
    flat = np.concatenate(vectors) if len(vectors) else np.zeros((0, dim), dtype=np.float32)
    tokens = pa.ListArray.from_arrays(
        pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dim, pa.int32()),
        pa.array(np.ascontiguousarray(flat, dtype=np.float32).ravel()),
    )
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), tokens, mask=pa.array(missing))


def windows(text: str, limit: int) -> list[str]:
    """The whole text in pieces of at most ``limit`` characters, cut at white space where there is some."""
    out, begin = [], 0
    while len(text) - begin > limit:
        space = max(text.rfind(c, begin + 1, begin + limit) for c in " \n\t")
        end = space if space > begin else begin + limit
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def _safely(embed_all, texts: list[str], dim: int) -> list[np.ndarray | None]:
    """Multivectors of texts; if the model fails on them together, one by one, and null where it fails."""
    if not texts:
        return []
    try:
        return list(embed_all(texts))
    except Exception:  # noqa: BLE001 - one bad text must not lose the others
        if len(texts) == 1:
            return [None]
        return [v for t in texts for v in _safely(embed_all, [t], dim)]


def embed(
    df: DataFrame, text_col: str, model: Embedder, out: str = "vectors", as_query: bool = False, window_chars: int | None = None
) -> DataFrame:
    """Append a multivector column. Rows are embedded in Arrow batches where they lie; no shuffle.

    ``text_col`` is consumed; rows whose text holds no token get an empty multivector. With
    ``window_chars`` a longer text is embedded window by window and has the tokens of all of them. A text
    that the model fails on gets null; a query that it fails on raises.
    """
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, VECTORS, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            if as_query:
                found = list(model.embed_queries(texts))
            else:
                pieces = [windows(t, window_chars) if window_chars else [t] for t in texts]
                made = iter(_safely(model.embed_texts, [p for own in pieces for p in own], model.dim))
                found = [_joined([next(made) for _ in own]) for own in pieces]
            columns = [batch.column(c) for c in keep] + [to_arrow_multivectors(found, model.dim)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return df.mapInArrow(run, schema)


def embed_images(df: DataFrame, image_col: str, model, out: str = "vectors") -> DataFrame:
    """Append the multivector of an image column; an image the model refuses gets null."""
    keep = [c for c in df.columns if c != image_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, VECTORS, True)])

    def one(image: bytes):
        try:
            return np.asarray(model.embed_images([image])[0], dtype=np.float32)
        except Exception:  # noqa: BLE001 - one bad page must not lose the chunk
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(i) for i in batch.column(image_col).to_pylist()]
            nested = pa.array([None if m is None else m.tolist() for m in made], pa.list_(pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [nested], names=[*keep, out])

    return df.mapInArrow(run, schema)
