"""Near-duplicates by meet-in-the-middle ball hashing of fingerprints.

``near_duplicates`` takes 64-bit SimHash fingerprints. ``similar_documents`` takes short one-permutation
sketches, several of them for each text, which find pairs of a Jaccard similarity of 0.8 that SimHash
leaves too far apart. Both use the same half-balls.

Two fingerprints that differ in at most three bits meet at a point that is at most one bit from one of
them and at most two bits from the other. So every distinct fingerprint emits itself, its 64 one-bit
variants, and the two-bit variants that clear two set bits. That half-ball is complete: of three
differing bits one of the two fingerprints has at least two set, it clears these, and the other one
flips the third. It is about 560 points for a fingerprint instead of the 2,081 of the full ball.

Points are shuffled in packed form (per bucket: the fingerprints used, how often, and 2 bytes a point).
At a point, whoever is within one bit is within three bits of everyone there, so a star around the
smallest such fingerprint carries the links of the whole group, without all pairs. A group cannot grow
with the data: at most 2,081 different fingerprints lie within two bits of a point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.llm.components import components
from quillfin.llm.fingerprint import signatures
from quillfin.llm.words import mixed, rows_in_steps, utf8, words
from quillfin.session import checkpoint_dir, gathered

RADIUS = 3
SHINGLE = 3
SEED = 42
# Points that one reduce group handles, and fingerprints whose points are made at a time (about 100 MB).
POINTS_PER_BUCKET = 2_000_000
PRINTS_PER_STEP = 4_096
_TILE = 1_024

# Sketches: so many fingerprints of so many bits, and bins in all; what two texts must agree in. At a
# similarity of 0.8 a bit differs with probability 0.1, and one fingerprint or more of six is within
# three bits with probability 0.96. Pairs then count as candidates by the similarity that all bins together
# estimate; its standard error is 0.027 there, so the limit is two of these lower. The texts decide.
TABLES, TABLE_BITS, SKETCH_BINS = 6, 40, 512
SIMILARITY, ERROR = 0.8, 0.027
# Members of a star or texts of a region, and bytes of these texts, in a block; a task compares one or two blocks.
BLOCK_NODES, BLOCK_BYTES = 4_096, 8 << 20
# Texts that one task reads.
TEXTS_PER_TASK = 1_000

_ONE = np.uint64(1)


def masks(width: int) -> np.ndarray:
    """The bits, of the lowest ``width``, that each code flips: none, one, or two."""
    singles = np.concatenate([np.zeros(1, np.uint64), _ONE << np.arange(width, dtype=np.uint64)])
    p, q = np.triu_indices(width, 1)
    return np.concatenate([singles, (_ONE << p.astype(np.uint64)) | (_ONE << q.astype(np.uint64))])


MASKS = masks(64)


def simhashes(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text; bit i is set if it is set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for begin, end in rows_in_steps(texts):
        w = words(texts.slice(begin, end - begin), lower=True)
        first, count, bounds = w.runs(shingle, whole_if_shorter=True)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        h = w.hashes(first, count, seed)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
        majority = 2 * set_ > np.diff(bounds)[some][:, None]
        out[begin + some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp)`` per row, ``fp`` as a signed long; null and wordless texts get zero."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = simhashes(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(prints, f"`{id_col}` {kind}, fp long")


def links(prints: DataFrame, points_per_bucket: int = POINTS_PER_BUCKET, width: int = 64, tables: int = 1) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints ``fp`` (distinct, not null) differing in at most
    three of the lowest ``width`` bits and in no other. Every edge is such a pair; pairs connected through
    others may be left out. The bits above tell ``tables`` tables apart, which have buckets of their own."""
    n = prints.count()
    points_per_print = 1 + width + width * (width - 1) // 8
    buckets = max(1, -(-n * points_per_print // (points_per_bucket * tables)))
    flips = masks(width)
    # The points are many times the prints, so their tasks are counted by points.
    steps = prints.select("fp").repartition(max(1, -(-n // PRINTS_PER_STEP)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _steps(batches):
            yield _packed(fps, buckets, flips, width, tables)

    def stars(group: pa.Table) -> pa.Table:
        return _stars(group, flips, width)

    points = steps.mapInArrow(emit, "bucket int, fps binary, times binary, code binary")
    found = points.groupBy("bucket").applyInArrow(stars, "a long, b long")
    return found.distinct()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= PRINTS_PER_STEP:
            together = np.concatenate(held)
            whole = n - n % PRINTS_PER_STEP
            yield from np.split(together[:whole], whole // PRINTS_PER_STEP)
            held, n = [together[whole:]], n - whole
    if n:
        yield np.concatenate(held)


def _points(fps: np.ndarray, flips: np.ndarray = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``fps`` and code of every point of every half-ball."""
    near = int((np.bitwise_count(flips) < 2).sum())
    pairs = flips[near:]
    index, code = [], []
    for at in range(0, len(fps), _TILE):
        tile = fps[at : at + _TILE]
        i, c = np.nonzero((tile[:, None] & pairs) == pairs)
        index += [np.repeat(np.arange(at, at + len(tile)), near), i + at]
        code += [np.tile(np.arange(near), len(tile)), c + near]
    return np.concatenate(index).astype(np.uint16), np.concatenate(code).astype(np.uint16)


def _packed(fps: np.ndarray, buckets: int, flips: np.ndarray = MASKS, width: int = 64, tables: int = 1) -> pa.RecordBatch:
    """Per bucket the fingerprints with points in it, how many each has, and the codes of these points."""
    index, code = _points(fps, flips)
    table = (fps >> np.uint64(width)).astype(np.int64)[index] if tables > 1 else 0
    bucket = table * buckets + (mixed(fps[index] ^ flips[code]) % np.uint64(buckets)).astype(np.int64)
    key = bucket * len(fps) + index
    order = np.argsort(key)
    key, code = key[order], code[order]
    cuts = np.searchsorted(key, np.arange(buckets * tables + 1) * len(fps))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[b], cuts[b + 1])
        used, times = np.unique(key[part] - b * len(fps), return_counts=True)
        rows.append((int(b), fps[used].tobytes(), times.astype(np.uint16).tobytes(), code[part].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "fps", "times", "code"])


def _stars(group: pa.Table, flips: np.ndarray, width: int) -> pa.Table:
    fps, code = [], []
    for row in group.to_batches():
        for f, times, c in zip(row.column("fps"), row.column("times"), row.column("code")):
            fps.append(np.repeat(np.frombuffer(f.as_buffer(), np.uint64), np.frombuffer(times.as_buffer(), np.uint16)))
            code.append(np.frombuffer(c.as_buffer(), np.uint16))
    fps, code = np.concatenate(fps), np.concatenate(code)
    point = fps ^ flips[code]
    order = np.argsort(point)
    same = point[order]
    begins = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    sizes = np.diff(np.append(begins, len(same)))
    # Only points where several fingerprints meet matter from here on.
    shared = np.repeat(sizes > 1, sizes)
    order = order[shared]
    group_of = np.repeat(np.arange(len(sizes)), sizes)[shared]
    fps, near = fps[order], code[order] <= width
    # The hub: the smallest fingerprint within one bit of the point.
    rank = np.lexsort((fps, ~near, group_of))
    fps, near, group_of = fps[rank], near[rank], group_of[rank]
    heads = np.flatnonzero(np.append(True, group_of[1:] != group_of[:-1])) if len(group_of) else np.zeros(0, int)
    size = np.diff(np.append(heads, len(group_of)))
    hub, has_hub = np.repeat(fps[heads], size), np.repeat(near[heads], size)
    linked = has_hub & (fps != hub) & (np.bitwise_count(fps ^ hub) <= RADIUS)
    pairs = np.unique(np.stack([hub[linked], fps[linked]], 1), axis=0).view(np.int64)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``docs``.

    Rows whose fingerprints differ in at most three bits are linked; ``component_id`` is the smallest id
    reachable. Equal fingerprints (equal texts, all wordless or null texts) are one class from the start,
    so a third of all rows being copies costs one class. Null ids are kept and count only if a component
    has no other. Columns of ``docs`` other than the two named are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least")).checkpoint()
    labels = components(links(classes))
    member = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    # A class may own any share of the rows; adaptive execution splits its side of this join.
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id_col, text_key, sketch, n_bytes)`` per row: Spark's hash of the text, the low bit of each bin, packed
    (all zero for null and wordless texts), and the length of the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = signatures(batch.column(2), SKETCH_BINS, 1, shingle)
            rows = [r.tobytes() for r in np.packbits(bits, axis=1)]
            n_bytes = pa.array(np.diff(utf8(batch.column(2))[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary()), n_bytes], [id_col, "text_key", "sketch", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, F.xxhash64(text_col).alias("text_key"), text_col)
    return keyed.mapInArrow(made, f"`{id_col}` {kind}, text_key long, sketch binary, n_bytes long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``(id_col, text_key, component_id, first)`` per row of ``docs`` (ids not null): rows whose texts share at
    least ``similarity`` of their word shingles are linked, ``component_id`` is the smallest id reachable and
    ``first`` says whether the row has that id and, of the texts with it in the component, the one with the
    smallest ``text_key``, Spark's hash of the text. Rows with one id and other texts are other rows.

    Equal sketches (equal texts, all wordless or null texts) are one class. The six fingerprints of each
    class go through one pass of half-balls, told apart by their upper bits.

    Sketches divide the classes into regions: the pairs of the stars that they leave possible are linked, and
    so are regions with members that meet in a star and are as much alike, by a pair for each two regions
    that grow together there. All texts of a region are then compared with each other, where they lie
    together, and only links that join something leave the task. So no table holds the pairs of a group.
    """
    checkpoint_dir(docs.sparkSession)
    rows = sketches(docs, id_col, text_col, shingle).checkpoint()
    classes = (
        rows.groupBy("sketch").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_key", "n_bytes")).alias("least"))
        .select("sketch", F.xxhash64("sketch").alias("node"), "least.id", "least.text_key", "least.n_bytes").checkpoint()
    )

    # What follows are small rows, a few for each class; so many tasks do for them.
    n = classes.count()
    classes = gathered(classes, n)
    few = lambda df: gathered(df, TABLES * n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _ONE << np.arange(TABLE_BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1)[:, : TABLES * TABLE_BITS].reshape(-1, TABLES, TABLE_BITS).astype(np.uint64)
            fp = (bits * weights).sum(2) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(TABLE_BITS))
            node = np.repeat(batch.column(1).to_numpy(), TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(fp.ravel().view(np.int64)), pa.array(node)], ["fp", "node"])

    tables = classes.select("sketch", "node").mapInArrow(cut, "fp long, node long").checkpoint()
    heads = few(tables.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n"))).checkpoint()
    met = few(links(heads, width=TABLE_BITS, tables=TABLES)).checkpoint()
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"node_{side}"))
    across = few(met.join(of("a"), "a")).join(of("b"), "b").select("node_a", "node_b")
    same = tables.join(heads, "fp").where("node <> head").select(F.col("head").alias("node_a"), F.col("node").alias("node_b"))
    joined = few(across).unionAll(few(same)).where("node_a <> node_b")
    pairs = few(joined.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    limit = similarity - 2 * ERROR
    estimated = few(_alike(pairs, classes, limit, few)).checkpoint()
    # Each star with its hub, and each fingerprint of several classes.
    own = met.select("a").unionAll(heads.where("n > 1").select("fp")).distinct()
    stars = met.unionAll(own.select("a", F.col("a").alias("b"))).toDF("hub", "fp")
    across = _apart(stars, tables, classes, components(estimated), limit, few)
    regions = components(few(estimated.unionAll(across)))
    labels = _joined(regions, classes, docs, id_col, text_col, shingle, similarity)
    member = classes.join(labels, "node", "left").select("sketch", F.struct("id", "text_key").alias("own"), F.coalesce("component", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("own").alias("least"))
    named = member.join(least, "root").select("sketch", "least")
    # A class may own any share of the rows; adaptive execution splits its side of this join.
    is_first = (F.col(id_col) == F.col("least.id")) & (F.col("text_key") == F.col("least.text_key"))
    return rows.join(named, "sketch").select(id_col, "text_key", F.col("least.id").alias("component_id"), is_first.alias("first"))


def _alike(pairs: DataFrame, classes: DataFrame, limit: float, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sketches estimate a similarity of at least ``limit``."""
    sketch = lambda side: classes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_bits(batch.column(c)) for c in (2, 3))
            alike = _estimate(np.bitwise_count(a ^ b).sum(1))
            yield batch.filter(pa.array(alike >= limit)).select([0, 1])

    both = few(pairs.join(sketch("a"), "a")).join(sketch("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    return both.mapInArrow(checked, "a long, b long")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BINS // 64)


def _estimate(differ: np.ndarray) -> np.ndarray:
    return 1 - 2 * differ / SKETCH_BINS


def _joined(regions: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``(node, component)`` for the nodes that are linked: of the nodes of each region (``component`` of ``regions``),
    those whose texts share at least ``similarity`` of their word shingles.

    A region is dealt out in blocks. One of a single block is done with its first comparison. Of the others each
    block is joined by itself, twice, dealt out in two ways, which joins most of what belongs together. Then
    each block meets each block of the members outside of the largest component.
    """
    named = regions.withColumnRenamed("component", "region").join(classes, "node").select("region", "node", "id", "text_key", "n_bytes")
    sizes = named.groupBy("region").agg(_blocks().alias("blocks"))
    nodes = named.join(sizes, "region").checkpoint()
    n = nodes.count()
    large = nodes.where("blocks > 1")

    def compared(dealt: DataFrame) -> DataFrame:
        first = dealt.select("node", F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
        texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
        # Rows with the same id and text are one.
        texts = gathered(texts.join(first, ["_id", "_key"]), n, TEXTS_PER_TASK).dropDuplicates(["node"]).select("node", "text")
        placed = dealt.select("region", "block", "node", "label").join(texts, "node").select("region", "block", "node", "label", "text")
        within = lambda group: _within(group, shingle, similarity)
        return placed.groupBy("region", "block").applyInArrow(within, "a long, b long").checkpoint()

    def labelled(links: DataFrame) -> DataFrame:
        return large.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node"))

    links = compared(nodes.withColumn("label", F.col("node")).withColumn("block", _dealt(0, "blocks")))
    if large.isEmpty():
        return components(links)
    links = links.unionAll(compared(labelled(links).withColumn("block", _dealt(1, "blocks"))))
    members = labelled(links).checkpoint()
    kinds = members.groupBy("region", "label").agg(F.count("*").alias("n"))
    members = members.join(kinds.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "region")
    others = members.where("label <> main")
    both = members.join(others.groupBy("region").agg(_blocks().alias("other_blocks")), "region")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = both.withColumn("i", _dealt(0, "blocks")).withColumn("j", upto("other_blocks"))
    columns = both.where("label <> main").withColumn("i", upto("blocks")).withColumn("j", _dealt(2, "other_blocks"))
    dealt = rows.unionAll(columns).withColumn("block", F.col("i") * F.col("other_blocks") + F.col("j")).dropDuplicates(["region", "block", "node"])
    return components(links.unionAll(compared(dealt)))


def _blocks() -> Column:
    """How many blocks the rows of a group are dealt out in."""
    return F.ceil(F.greatest(F.sum("n_bytes") / BLOCK_BYTES, F.count("*") / BLOCK_NODES, F.lit(1)))


def _dealt(seed: int, blocks: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(blocks))


def _within(group: pa.Table, shingle: int, similarity: float) -> pa.Table:
    """Pairs of nodes whose texts share enough shingles, as few as join the labels that such pairs join."""
    node, label = (group.column(c).to_numpy() for c in ("node", "label"))
    if (label == label[0]).all():
        return _pairs(node, [])
    sets = []
    for part in group.column("text").chunks:
        for begin, end in rows_in_steps(part):
            sets += _shingles(part.slice(begin, end - begin), shingle)
    sizes = np.array([len(x) for x in sets])
    bounds = np.append(0, sizes.cumsum())
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    # The members with each shingle lie one after the other.
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(of, kind="stable")]
    times = np.bincount(of, minlength=1)
    begins = times.cumsum() - times

    def alike(i: int) -> np.ndarray:
        mine = of[bounds[i] : bounds[i + 1]]
        n = times[mine]
        at = np.repeat(begins[mine] - (n.cumsum() - n), n) + np.arange(n.sum())
        shared = np.bincount(holders[at], minlength=len(sets))
        return np.flatnonzero(shared >= similarity * (sizes[i] + sizes - shared))

    return _pairs(node, _joins(label, alike))


def _joins(label: np.ndarray, alike: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of alike members that join all labels that alike members join, one pair for each that is joined to another.

    Of two labels one is not the largest in the end, so it is enough to look at the members of all others.
    """
    _, of = np.unique(label, return_inverse=True)
    waiting, found = np.ones(len(of), bool), []
    while True:
        todo = np.flatnonzero(waiting & (of != np.bincount(of).argmax()))
        if not len(todo):
            return found
        i = todo[0]
        waiting[i] = False
        near = alike(i)
        near = near[of[near] != of[i]]
        while len(near):
            found.append((i, near[0]))
            of[of == of[near[0]]] = of[i]
            near = near[of[near] != of[i]]


def _pairs(node: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    ends = np.sort(node[np.array(found, int).reshape(-1, 2)], axis=1)
    return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})


def _shingles(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    w = words(texts)
    first, count, bounds = w.runs(shingle, whole_if_shorter=True)
    h = w.hashes(first, count)
    return [np.unique(h[b:e]) for b, e in zip(bounds[:-1], bounds[1:])]


def _apart(stars: DataFrame, tables: DataFrame, classes: DataFrame, labels: DataFrame, limit: float, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that meet in a star, are of different components and have sketches alike; of
    each block as few as join the components that such pairs join.

    A star is dealt out over tasks: the members of its largest component and the owned ones of the others
    in blocks, and to each block all members of the others. ``few`` deals a table out over fewer tasks.
    """
    placed = few(tables.join(labels, "node", "left")).select("fp", "node", F.coalesce("component", "node").alias("label"))
    kinds = few(stars.join(placed.groupBy("fp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "fp"))
    mixed_hubs = kinds.groupBy("hub").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("hub")
    members = few(few(stars.join(mixed_hubs, "hub")).join(placed, "fp").select("hub", "node", "label")).checkpoint()
    counts = members.groupBy("hub", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("hub").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil(F.sum("n") / BLOCK_NODES).alias("blocks"))
    home = _dealt(1, "blocks")
    dealt = (
        few(few(members.join(sizes, "hub")).join(classes.select("node", "sketch"), "node"))
        .withColumn("home", home).withColumn("main", F.col("label") == F.col("main"))
        .withColumn("block", F.explode(F.when(F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        .select("hub", "block", "node", "label", (F.col("home") == F.col("block")).alias("own"), "sketch")
    )

    def joins(group: pa.Table) -> pa.Table:
        return _across(group, limit)

    return dealt.groupBy("hub", "block").applyInArrow(joins, "a long, b long").distinct()


def _across(group: pa.Table, limit: float) -> pa.Table:
    """Pairs of members, one of them owned, with sketches alike, as few as join the labels that such pairs join."""
    node, label, own = (group.column(c).to_numpy() for c in ("node", "label", "own"))
    sketch = _bits(group.column("sketch"))
    everyone, owned = np.arange(len(node)), np.flatnonzero(own)

    def alike(i: int) -> np.ndarray:
        among = everyone if own[i] else owned
        return among[_estimate(np.bitwise_count(sketch[among] ^ sketch[i]).sum(1)) >= limit]

    return _pairs(node, _joins(label, alike))
