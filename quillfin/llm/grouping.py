"""Packing token sequences by the linear grouping scheme.

Only how many pieces have each length matters for the plan, and there are no more lengths than the
capacity. So the plan is made from that histogram: it takes as long for any number of documents.

1. Large lengths, in falling order, are cut into groups of equal cardinality and rounded up to the
   largest of their group, which leaves a few sizes.
2. The linear programme over configurations (which sizes share a sequence) is solved by column
   generation; a knapsack over the duals prices the columns. Its basis has one configuration per size.
3. Whole multiples of these configurations are filled with actual pieces, which are never longer than
   the size they stand for. Rounding leaves gaps, so it is also tried to leave the smallest place of
   each configuration open: the next step then picks the actual length that fits there best.
4. What is left over, and all small pieces, go best-fit into the gaps, the longest first.
   The plan with the fewest sequences is taken.

All of it is kept as runs: ``count`` sequences in a row that hold pieces of the same lengths. The plan is
a few thousand runs, bounded by the capacity, and is broadcast. A piece finds its place by its rank among
the pieces of its length, counted per partition first, so that one very common length is no hot key.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.session import checkpoint_dir

CAPACITY = 2048
GROUPS = 64
# Pieces longer than this share of the capacity are grouped; the others are small. Each is tried: with
# few small pieces to fill the gaps it is better to group less. A half is none of them: configurations would be
# single pieces, and the plan best-fit decreasing.
LARGE = (1 / 8, 1 / 4, 3 / 8, 7 / 16)
END_ID = 0

Place = tuple[int, int, int, int, int, int]


def byte_bpe(ranks_path: str, special: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """An encoder with the ids that ``tokenizers`` gives for the same vocabulary (its special tokens,
    where they occur in a text, are single ids), at three times the speed."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    special = {"<|endoftext|>": len(ranks)} if special is None else special
    encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def pack(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences: ``id_col, piece, start, length, ids_crc32,
    sequence_id, offset``, and with ``with_ids`` the ``ids`` as packed little-endian 32-bit numbers.

    A row is its text's ids and then id 0 (null and empty texts: just that). A longer row is cut, the
    first piece being the shorter one. Sequences are gapless from offset 0. Repeated rows and rows with
    null or equal ids are packed each for itself; other columns are ignored.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    pieces = _pieces(docs, ranks_path, id_col, text_col, capacity, with_ids).checkpoint()
    parts = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).checkpoint()
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        [tuple(map(int, p)) for p in plan_of(lengths, capacity)],
        "length long, rank_from long, rank_to long, sequence long, at long, copies long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("passed") + F.col("nth"))
    run = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(plan), "length")
        .where("rank >= rank_from and rank < rank_to")
        .select(
            id_col, "piece", "start", "length", "ids_crc32",
            (F.col("sequence") + F.expr("(rank - rank_from) div copies")).alias("sequence_id"),
            (F.col("at") + F.pmod(run, F.col("copies")) * F.col("length")).alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )


def _pieces(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = byte_bpe(ranks_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for nth, (start, end) in enumerate(spans(len(ids), capacity)):
                    own = ids[start:end].tobytes()
                    owner.append(i)
                    rows.append((nth, start, end - start, zlib.crc32(own), seen[end - start], own if with_ids else None))
                    seen[end - start] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *columns, pa.array([part] * len(owner), pa.int32())], names
            )

    names = [id_col, "piece", "start", "length", "ids_crc32", "nth", "ids", "part"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, nth long, ids binary, part int"
    found = docs.select(id_col, text_col).mapInArrow(cut, schema)
    return found if with_ids else found.drop("ids")


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces of ``n`` ids: whole ones at the end, the remainder first."""
    first = n % capacity or capacity
    return [(max(0, end - capacity), end) for end in range(first, n + 1, capacity)] if n > capacity else [(0, n)]


def plan_of(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> list[Place]:
    """Places for all pieces, given how many there are of each length.

    ``(length, rank_from, rank_to, sequence, at, copies)``: of the pieces of this length those with these
    ranks lie ``copies`` to a sequence, from ``sequence`` on, the first one at offset ``at``.
    """
    held = Counter({n: c for n, c in lengths.items() if c > 0})
    tried = []
    for share in large:
        big = [(n, held[n]) for n in sorted(held, reverse=True) if n > capacity * share]
        grouped = _grouped(big, groups) if big else []
        configured = _configurations(grouped, capacity) if big else []
        for spare in (0, 1):
            bins, left, queues = _Bins(capacity), Counter(held), [[list(run) for run in g] for g in grouped]
            for members, times in configured:
                bins.fill([queues[g] for g in members[: len(members) - spare]], times, left)
            for n in sorted(left, reverse=True):
                bins.best_fit(n, left[n])
            tried.append(bins)
    return min(tried, key=lambda bins: bins.next).places


def _grouped(big: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Falling (length, count) runs in groups of equal cardinality."""
    total = sum(c for _, c in big)
    each = -(-total // groups)
    out: list[list[list[int]]] = [[]]
    room = each
    for n, c in big:
        while c:
            if not room:
                out.append([])
                room = each
            take = min(c, room)
            out[-1].append([n, take])
            c, room = c - take, room - take
    return out


def _configurations(grouped: list[list[list[int]]], capacity: int) -> list[tuple[list[int], int]]:
    """The basis of the linear programme, rounded down: for each configuration the groups that share a
    sequence, the largest first, and of how many sequences."""
    sizes = np.array([g[0][0] for g in grouped])
    demand = np.array([float(sum(c for _, c in g)) for g in grouped])
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * len(sizes)):
        inverse = np.linalg.inv(basis)
        column, value = _priced(sizes, inverse.sum(0), capacity)
        if value <= 1 + 1e-9:
            break
        x, move = inverse @ demand, inverse @ column
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    times = np.linalg.solve(basis, demand)
    out = []
    for column, t in zip(basis.T, times):
        members = [g for g in range(len(sizes)) for _ in range(int(round(column[g])))]
        out.append((members, int(max(t, 0) + 1e-6)))
    return out


def _priced(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable set of sizes within the capacity, by dynamic programming over its cardinality."""
    best = np.zeros(capacity + 1)
    picks = []
    shifted = np.full((len(sizes), capacity + 1), -np.inf)
    for _ in range(capacity // int(sizes.min())):
        for i, s in enumerate(sizes):
            shifted[i, s:] = best[: capacity + 1 - s] + worth[i]
        choice = shifted.argmax(0)
        better = shifted[choice, np.arange(capacity + 1)]
        gain = better > best + 1e-12
        picks.append(np.where(gain, choice, -1))
        best = np.where(gain, better, best)
        if not gain.any():
            break
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return column, float(column @ worth)


class _Bins:
    """Runs of sequences ``(first, count)`` by the room that each of them has left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next = capacity, 0
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self.rank: Counter = Counter()
        self.places: list[Place] = []

    def _add(self, room: int, first: int, count: int) -> None:
        if not room or not count:
            return
        if room not in self.open:
            insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append((first, count))

    def _place(self, n: int, count: int, first: int, at: int, copies: int = 1) -> None:
        self.places.append((n, self.rank[n], self.rank[n] + count, first, at, copies))
        self.rank[n] += count

    def fill(self, members: list[list[list[int]]], times: int, left: Counter) -> None:
        """``times`` sequences, each with one piece of each member group; groups give their longest first."""
        if not members or not times:
            return
        slots = []
        for group in members:
            slot, need = [], times
            while need:
                n, c = group[0]
                take = min(c, need)
                slot.append([n, take])
                need -= take
                group[0][1] -= take
                left[n] -= take
                if not group[0][1]:
                    group.pop(0)
            slots.append(slot)
        done = 0
        while done < times:
            count = min(slot[0][1] for slot in slots)
            at = 0
            for slot in slots:
                self._place(slot[0][0], count, self.next, at)
                at += slot[0][0]
                slot[0][1] -= count
                if not slot[0][1]:
                    slot.pop(0)
            self._add(self.capacity - at, self.next, count)
            self.next += count
            done += count

    def best_fit(self, n: int, count: int) -> None:
        """``count`` pieces of one length, each into the least room that holds it."""
        while count:
            i = bisect_left(self.rooms, n)
            if i == len(self.rooms):
                each = self.capacity // n
                self._add(self.capacity, self.next, -(-count // each))
                self.next += -(-count // each)
                continue
            room = self.rooms[i]
            first, many = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[i]
            each, at = room // n, self.capacity - room
            used = min(many, count // each)
            if used:
                self._place(n, used * each, first, at, each)
                self._add(room - each * n, first, used)
            count -= used * each
            if used < many and count:
                # The last sequence takes what is left, fewer than would fit.
                self._place(n, count, first + used, at, count)
                self._add(room - count * n, first + used, 1)
                used, count = used + 1, 0
            self._add(room, first + used, many - used)
