"""Substring dedup with a count-min prefilter.

Texts are dealt to chunks of a few megabytes by hash, once; three passes read that one shuffle.

1. Each chunk sketches its distinct windows: one row of counters, ``CELLS_PER_WINDOW`` of them for each window
   of the whole input. Nearly all counters of a chunk are zero, so the sketch travels in sparse form, as sorted
   cells, about three bytes each. Sketches are merged segment by segment. A merged counter never underestimates
   in how many chunks a window is, so no repeated window is lost. Each chunk is told, one bit for each of
   its cells, which counters reached two.
2. Each chunk sends the windows whose counter did, once each with the smallest of its documents, to be grouped
   exactly by 96 bits of hash. A chunk is told which of its windows a smaller document elsewhere has.
3. Each chunk cuts these, and what its own documents repeat among themselves, which never left it.

No sketch is ever whole in one place: the row of counters grows with the input, and so does the number of
segments, each merged by a task of its own. So the share of unique windows that pass (about one in
``CELLS_PER_WINDOW``) and the memory of a task are the same for any input. A passage that a third of all documents
share is sent once per chunk. What shrinks with the input are the messages between a chunk and a
segment: at 30 GB of text about 900 windows, at 3 TB nine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.words import Words, chained, mixed, rows_in_steps, utf8, words

WINDOW = 13
CELLS_PER_WINDOW = 64
# Text of one chunk, and windows of the input for each segment of the sketch.
CHUNK_BYTES = 6 << 20
WINDOWS_PER_SEGMENT = 4_000_000
# Average bytes of a word and its space, only to size the sketch.
WORD_BYTES = 6

# Columns that travel with each row: its id, hashes that tell rows apart, equal rows and the chunk.
_ID, _TEXT_KEY, _ROW_KEY, _COPIES, _CHUNK = (f"_countmin_{x}" for x in ("id", "text_key", "row_key", "copies", "chunk"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a
    smaller id. ``kept_text`` is the text without these words and the white space behind them;
    ``kept_sha256`` digests the kept words joined by one space. Null and wordless texts have no windows.
    Rows with a null id lose nothing and make others lose nothing; rows with the same id don't count
    against each other. Rows equal in all columns are combined batch by batch before the shuffle and come back
    in their number. Columns of ``docs`` with the names of the new ones are replaced.
    """
    new = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string"}
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    edges = segment_edges(size // WORD_BYTES)
    rows = _dealt(docs.select(*[c for c in docs.columns if c not in new]), id_col, text_col, 1 + size // CHUNK_BYTES)

    def sketched(group: pa.Table) -> pa.Table:
        return _sketch(_Distinct(group, text_col, window), edges, _chunk_of(group))

    def suspected(group: pa.Table, hits: pa.Table) -> pa.Table:
        return _suspects(_Distinct(group, text_col, window), hits, edges, _chunk_of(group))

    def cut(group: pa.Table, gone: pa.Table) -> pa.Table:
        return _cut(group, gone, text_col, window)

    by_chunk = rows.groupBy(_CHUNK)
    cells = by_chunk.applyInArrow(sketched, "segment long, chunk long, gaps binary")
    hits = cells.groupBy("segment").applyInArrow(_merged, "segment long, chunk long, bits binary")
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(
        suspected, "segment long, chunk long, number binary, ids binary, document binary, hash binary, check binary"
    )
    gone = sent.groupBy("segment").applyInArrow(_settled, "chunk long, number binary")
    kept_columns = [f for f in rows.schema.fields if f.name not in (_ID, _TEXT_KEY, _ROW_KEY, _CHUNK)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns] + [f"{n} {t}" for n, t in new.items()])
    done = by_chunk.cogroup(gone.groupBy("chunk")).applyInArrow(cut, schema)
    each = F.explode(F.array_repeat(F.lit(0), F.col(_COPIES))).alias(_COPIES)
    return done.select(*[c for c in done.columns if c != _COPIES], each).drop(_COPIES)


def segment_edges(n_windows: int) -> np.ndarray:
    """The sketch's segments: the first cell of each, and behind them the number of all cells, a power of two."""
    bits = max(int(max(n_windows, 1) * CELLS_PER_WINDOW).bit_length(), 8)
    segments = 1 + n_windows // WINDOWS_PER_SEGMENT
    return np.array([(s << bits) // segments for s in range(segments)] + [1 << bits], np.int64)


def _dealt(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """``docs`` and the columns above. A row's chunk follows from its values, so a lost one is made again as it was."""
    others = [
        # Maps and variants have no hash.
        F.to_json(F.struct(f.name)) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`")
        for f in docs.schema.fields if f.name != text_col
    ]
    keyed = docs.select(
        "*", F.col(id_col).cast("long").alias(_ID), F.xxhash64(text_col).alias(_TEXT_KEY),
        F.xxhash64(F.col(text_col).isNull(), *others).alias(_ROW_KEY), F.lit(1).alias(_COPIES),
    )
    combined = keyed.mapInArrow(_combined, keyed.schema)
    return combined.withColumn(_CHUNK, F.pmod(F.xxhash64(_TEXT_KEY, _ROW_KEY), F.lit(chunks)))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are equal in both hashes, as one with their number."""
    for batch in batches:
        keys = np.stack([batch.column(_TEXT_KEY).to_numpy(), batch.column(_ROW_KEY).to_numpy()], 1)
        _, first, copies = np.unique(keys, axis=0, return_index=True, return_counts=True)
        if len(first) == len(keys):
            yield batch
        else:
            at = batch.schema.get_field_index(_COPIES)
            yield batch.take(pa.array(first)).set_column(at, _COPIES, pa.array(copies.astype(np.int32)))


def _chunk_of(group: pa.Table) -> int:
    return group.column(_CHUNK)[0].as_py() if group.num_rows else 0


class _Distinct:
    """The distinct windows of a chunk in the order of their hashes, whatever order its rows come in.

    ``number`` is that of each occurrence, in row ``row`` at word ``start``; ``least`` the smallest id of each distinct one.
    """

    def __init__(self, group: pa.Table, text_col: str, window: int):
        # Rows without an id have no windows here.
        id_ = group.column(_ID).combine_chunks()
        texts = group.column(text_col).combine_chunks()
        self.texts = pc.if_else(id_.is_valid(), texts, pa.scalar(None, texts.type))
        self.ids = id_.fill_null(0).to_numpy()
        parts = list(_windows(self.texts, window))
        kinds = (np.int64, np.int64, np.uint64, np.uint64)
        row, start, h, check = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, k) for k in kinds)
        check = check.astype(np.uint32)
        order = np.lexsort((check, h))
        self.row, self.start, h, check = row[order], start[order], h[order], check[order]
        head = np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]))[: len(h)]
        first = np.flatnonzero(head)
        self.number = np.cumsum(head) - 1
        self.hash, self.check = h[first], check[first]
        self.least = np.minimum.reduceat(self.ids[self.row], first) if len(first) else self.ids[:0]

    def cells(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct cells, where each segment of them begins and ends, and the cell of each distinct window."""
        all_ = (self.hash >> np.uint64(64 - (int(edges[-1]).bit_length() - 1))).astype(np.int64)
        head = np.append(True, all_[1:] != all_[:-1])[: len(all_)]
        cells = all_[head]
        return cells, np.searchsorted(cells, edges), np.cumsum(head) - 1


def _windows(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, start, hash and second hash of the windows of each step of texts."""
    for begin, end in rows_in_steps(texts):
        w = words(texts.slice(begin, end - begin))
        first, _, bounds = w.runs(window)
        if not len(first):
            continue
        one = w.hashes(np.arange(len(w.start)), np.ones(len(w.start), np.int64))
        rows = np.repeat(np.arange(begin, end), np.diff(bounds))
        # Two chains over different word hashes; their windows are those that don't cross texts.
        yield rows, first - w.first[rows - begin], chained(one, window)[first], chained(mixed(one + np.uint64(1)), window)[first]


def _sketch(chunk: _Distinct, edges: np.ndarray, name: int) -> pa.Table:
    """The counters that are not zero, per segment."""
    cells, cuts, _ = chunk.cells(edges)
    hit = np.flatnonzero(np.diff(cuts))
    gaps = [packed_gaps(cells[cuts[s] : cuts[s + 1]] - edges[s]) for s in hit]
    return pa.table({"segment": pa.array(hit, pa.int64()), "chunk": pa.array([name] * len(hit), pa.int64()), "gaps": pa.array(gaps, pa.binary())})


def _merged(group: pa.Table) -> pa.Table:
    """For each chunk's cells of a segment, whether their merged counter reached two."""
    lists = [unpacked_gaps(np.frombuffer(gaps.as_buffer(), np.uint8)) for gaps in group.column("gaps")]
    cell = np.concatenate(lists)
    # Each list ascends, which a stable sort makes use of.
    order = np.argsort(cell, kind="stable")
    same = cell[order[1:]] == cell[order[:-1]]
    twice = np.zeros(len(cell), bool)
    twice[order] = np.append(False, same) | np.append(same, False)
    ends = np.cumsum([len(x) for x in lists])
    bits = [np.packbits(x).tobytes() for x in np.split(twice, ends[:-1])]
    return group.select(["segment", "chunk"]).append_column("bits", pa.array(bits, pa.binary()))


def packed_gaps(ascending: np.ndarray) -> bytes:
    """Ascending numbers under 2^35 as differences in base-128 bytes, the high bit marking a last byte."""
    gaps = np.diff(ascending, prepend=0)
    size = 1 + sum((gaps >> (7 * i) > 0).astype(np.int64) for i in range(1, 5))
    last = np.cumsum(size) - 1
    out = np.zeros(last[-1] + 1 if len(last) else 0, np.uint8)
    for i in range(5):
        has = size > i
        out[(last[has] - i)] = (gaps[has] >> (7 * i)) & 127
    out[last] |= 128
    return out.tobytes()


def unpacked_gaps(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data & 128)
    size = np.diff(last, prepend=-1)
    gaps = np.zeros(len(last), np.int64)
    for i in range(5):
        has = size > i
        gaps[has] |= (data[last[has] - i] & 127).astype(np.int64) << (7 * i)
    return np.cumsum(gaps)


def _suspects(chunk: _Distinct, hits: pa.Table, edges: np.ndarray, name: int) -> pa.Table:
    """Windows whose merged counter reached two, each with the chunk's smallest document, per segment."""
    cells, cuts, cell_of = chunk.cells(edges)
    twice = np.zeros(len(cells), bool)
    for segment, bits in zip(hits.column("segment").to_pylist(), hits.column("bits")):
        begin, end = cuts[segment], cuts[segment + 1]
        twice[begin:end] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=end - begin)
    number = np.flatnonzero(twice[cell_of])
    bounds = np.searchsorted(cell_of[number], cuts)
    out = []
    for s in np.flatnonzero(np.diff(bounds)):
        own = number[bounds[s] : bounds[s + 1]]
        ids, document = np.unique(chunk.least[own], return_inverse=True)
        out.append((int(s), name, packed_gaps(own), ids.tobytes(), _small(document), chunk.hash[own].tobytes(), chunk.check[own].tobytes()))
    kinds = {"segment": pa.int64(), "chunk": pa.int64(), **{c: pa.binary() for c in ("number", "ids", "document", "hash", "check")}}
    return pa.table({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), list(zip(*out)) or [[]] * 7)})


def _small(a: np.ndarray) -> bytes:
    return a.astype(np.uint16 if a.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _settled(group: pa.Table) -> pa.Table:
    """Of each chunk's windows of a segment, those that a smaller document of another chunk has, too."""
    parts = []
    for record in group.to_batches():
        for i in range(record.num_rows):
            ids, h, check = (np.frombuffer(record.column(c)[i].as_buffer(), k) for c, k in (("ids", np.int64), ("hash", np.uint64), ("check", np.uint32)))
            document = record.column("document")[i].as_buffer()
            parts.append((ids[np.frombuffer(document, np.uint16 if document.size == 2 * len(h) else np.uint32)], h, check))
    ids, h, check = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, check, h))
    a, b, c = ids[order], h[order], check[order]
    heads = np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
    later = np.zeros(len(ids), bool)
    later[order] = a > a[heads][np.cumsum(heads) - 1]
    ends = np.cumsum([len(p[0]) for p in parts])
    found = []
    for mine, number in zip(np.split(later, ends[:-1]), group.column("number")):
        found.append(packed_gaps(unpacked_gaps(np.frombuffer(number.as_buffer(), np.uint8))[mine]) if mine.any() else None)
    out = pa.table({"chunk": group.column("chunk"), "number": pa.array(found, pa.binary())})
    return out.filter(out.column("number").is_valid())


def _cut(group: pa.Table, gone: pa.Table, text_col: str, window: int) -> pa.Table:
    """The rows of a chunk without the windows that a smaller document has, in this chunk or another one."""
    chunk = _Distinct(group, text_col, window)
    elsewhere = np.zeros(len(chunk.hash), bool)
    for number in gone.column("number"):
        elsewhere[unpacked_gaps(np.frombuffer(number.as_buffer(), np.uint8))] = True
    out = elsewhere[chunk.number] | (chunk.ids[chunk.row] > chunk.least[chunk.number])
    row, start = chunk.row[out], chunk.start[out]
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(group.num_rows + 1))
    start = start[order].astype(np.uint32)
    starts = pa.array([start[b:e].tobytes() if b < e else None for b, e in zip(cuts[:-1], cuts[1:])], pa.binary())
    texts = group.column(text_col).combine_chunks()
    steps = [_kept(texts.slice(b, e - b), starts.slice(b, e - b), window) for b, e in rows_in_steps(texts)]
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
    kept = group.drop_columns([_ID, _TEXT_KEY, _ROW_KEY, _CHUNK])
    for i, (name, kind) in enumerate(kinds.items()):
        kept = kept.append_column(name, pa.chunked_array([s[i] for s in steps], kind))
    return kept


def _kept(texts: pa.Array, starts: pa.Array, window: int) -> list[pa.Array]:
    w = words(texts)
    gone = _covered(w, starts, window)
    total = np.append(0, np.cumsum(gone))
    removed = total[w.first[1:]] - total[w.first[:-1]]
    # Kept words, each with its space.
    keep = np.repeat(~gone, w.end - w.start + 1)
    data = w.data[keep]
    bounds = np.append(0, np.cumsum(np.where(gone, 0, w.end - w.start + 1)))[w.first]
    digests = [hashlib.sha256(data[b : max(b, e - 1)].tobytes()).hexdigest() for b, e in zip(bounds[:-1], bounds[1:])]
    return [
        pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
        _cut_text(texts, w, gone, removed),
    ]


def _covered(w: Words, starts: pa.Array, window: int) -> np.ndarray:
    """Which words are covered by the windows that begin at the given positions."""
    change = np.zeros(len(w.start) + 1, np.int64)
    for i, own in enumerate(starts):
        if own.is_valid:
            at = np.unique(np.frombuffer(own.as_buffer(), np.uint32)).astype(np.int64) + w.first[i]
            change[at] += 1
            change[at + window] -= 1
    return np.cumsum(change)[:-1] > 0


def _cut_text(texts: pa.Array, w: Words, gone: np.ndarray, removed: np.ndarray) -> pa.Array:
    """The texts without removed words and the white space behind each; null stays null."""
    raw, offsets = utf8(texts)
    out = []
    for i, text in enumerate(texts):
        if not text.is_valid or not removed[i]:
            out.append(text.as_py())
            continue
        own = slice(w.first[i], w.first[i + 1])
        edges = np.append(w.at[own], offsets[i + 1])
        keep = np.repeat(~gone[own], np.diff(edges))
        body = np.concatenate([raw[offsets[i] : edges[0]], raw[edges[0] : offsets[i + 1]][keep]])
        out.append(body.tobytes().decode())
    return pa.array(out, pa.string())
