"""Merkle manifest of a dataset as a persistent tree that is built and versioned in blocks.

Leaves are digests of rows. Those of a source, in order, are a tree of runs of sixteen; the roots of the
sources, in order, are one more such tree. Places are dealt out by ranges of (source, id), so a source
with most of the rows is many ranges and no task counts it alone. Every aligned block of 256 leaves is one
group: it builds two levels and hands up one digest, and the next tier does the same with those,
until one is left.

On the way down a block gets the path of its own root to the top and writes a *version* for each of its
leaves: the tree with that leaf replaced. Versions share all nodes but the ancestors of the leaf, which
are copied; above the block the copying goes on along the path the block was given, so no version needs
more than its block and that path, wherever the other nodes are.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.session import checkpoint_dir

FAN = 16
# Levels that one block builds.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_HEX = 64
_PATH = "array<struct<place:int,siblings:string>>"
_ALL = "all"


def digest_of(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields' texts, each after its length in bytes and a colon, null as ``-``."""
    as_text = [f.cast("string") for f in fields]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]
    return F.sha2(F.concat(*marked), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Node:
    """A node that is never changed; a leaf has no ``kids``."""

    __slots__ = ("digest", "kids")

    def __init__(self, digest: str, kids: tuple[Node, ...] = ()):
        self.digest, self.kids = digest, kids

    @classmethod
    def over(cls, kids: Sequence[Node]) -> Node:
        return cls(_sha("".join(k.digest for k in kids)), tuple(kids))


def grown(digests: Sequence[str], levels: int | None) -> tuple[Node, int]:
    """The root over the digests and its height. A block of a larger tree has ``levels`` levels, even over
    one node; a whole tree, ``None``, ends where one node remains."""
    nodes, height = [Node(d) for d in digests], 0
    while len(nodes) > 1 if levels is None else height < levels:
        nodes = [Node.over(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        height += 1
    return nodes[0], height


def _turns(place: int, height: int) -> list[int]:
    """Which child leads to the leaf at ``place``, from the root down."""
    return [(place // FAN**level) % FAN for level in range(height - 1, -1, -1)]


def replaced(root: Node, turns: Sequence[int], leaf: str) -> list[Node]:
    """The nodes of a new version from its root to the leaf; all others are those of ``root``."""
    if not turns:
        return [Node(leaf)]
    below = replaced(root.kids[turns[0]], turns[1:], leaf)
    kids = root.kids[: turns[0]] + (below[0],) + root.kids[turns[0] + 1 :]
    return [Node.over(kids), *below]


def path_of(root: Node, turns: Sequence[int]) -> list[tuple[int, str]]:
    """Place among its run and digests of the run's other nodes, from the leaf's level up."""
    found = []
    for turn in turns:
        found.append((turn, "".join(k.digest for i, k in enumerate(root.kids) if i != turn)))
        root = root.kids[turn]
    return found[::-1]


def continued(digest: str, path: Sequence[tuple[int, str]]) -> list[str]:
    """Digests of the copied ancestors along ``path`` above a node that now has ``digest``."""
    copied = []
    for place, siblings in path:
        cut = place * _HEX
        digest = _sha(siblings[:cut] + digest + siblings[cut:])
        copied.append(digest)
    return copied


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``pos``, from 0 in ``order`` (nulls first) within each ``tree``, and the tree's ``size``.

    Equal rows get places in any order. ``rows`` is read twice, so it should be a written table.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)] + [F.col("_tie")]
    # Repeated rows are told apart, or a range could not split them.
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for name in batch.column(batch.schema.names.index(tree)).to_pylist():
                nth = nth + 1 if name == last else 0
                last = name
                at.append(nth)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "_part", "_at"]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    local = dealt.mapInArrow(count, schema).checkpoint()
    counts = local.groupBy(tree, "_part").agg(F.count("*").alias("_n"))
    own, earlier = Window.partitionBy(tree), Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(tree, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("size"))
    placed = local.join(offsets, [tree, "_part"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_before")).alias("pos"), "size")


def _blocks(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**levels)).groupBy("tree", "block")


def _tree_of(block: pa.Table, levels: int) -> tuple[pa.Table, Node, int]:
    """The block's rows in order, the root over them and its height."""
    block = block.sort_by("pos")
    whole = block["size"][0].as_py() <= FAN**levels
    return block, *grown(block["digest"].to_pylist(), None if whole else levels)


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each block of ``(tree, pos, digest, size)``."""

    def root(key: tuple, group: pa.Table) -> pa.Table:
        group, top, _ = _tree_of(group, levels)
        size = -(-group["size"][0].as_py() // FAN**levels)
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [top.digest], "size": [size]})

    return _blocks(nodes.select("tree", "pos", "digest", "size"), levels).applyInArrow(root, "tree string, pos long, digest string, size long")


def tiers(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` and the block roots above them, up to one node a tree, which is the tree's root."""
    most, found = nodes.agg(F.max("size")).first()[0] or 0, [nodes]
    while most > 1:
        found.append(_up(found[-1], levels).checkpoint())
        most = -(-most // FAN**levels)
    return found


def _down(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(tree, pos, path)`` for each node, its path to the top through its block's, ``(tree, block, path)``."""

    def paths(key: tuple, group: pa.Table, given: pa.Table) -> pa.Table:
        group, top, height = _tree_of(group, levels)
        rest = [(p["place"], p["siblings"]) for p in given["path"][0].as_py()]
        pos = group["pos"].to_pylist()
        found = [[{"place": i, "siblings": s} for i, s in [*path_of(top, _turns(p % FAN**levels, height)), *rest]] for p in pos]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))
        return pa.table({"tree": [key[0].as_py()] * len(pos), "pos": pos, "path": pa.array(found, kind)})

    given = above.groupBy("tree", "block")
    return _blocks(nodes.select("tree", "pos", "digest", "size"), levels).cogroup(given).applyInArrow(paths, f"tree string, pos long, path {_PATH}")


def _block_paths(upper: list[DataFrame], path: DataFrame, levels: int) -> DataFrame:
    """Paths of all blocks of the lowest tier, from that of each tree's root, ``(tree, path)``."""
    found = path.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(upper):
        found = _down(nodes, found, levels).withColumnRenamed("pos", "block")
    return found


def manifest(leaves: DataFrame, id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``copied``, ``folded_root`` and ``verified`` of each
    row of ``leaves``, which has ``id_col``, ``source_col``, ``leaf`` and ``changed``: the digest that the version of
    this row has in place of ``leaf``, or null to fold ``leaf`` itself.

    ``copied`` are the digests of the version's own nodes, from the leaf's parent to the root; ``folded_root``
    is the last. A null source is the first source, null ids are the first of their source. Rows with
    the same id follow each other by digest; equal rows are leaves of their own. A tree of one leaf has no
    nodes above it: the leaf is the root and its proof is the digest of nothing. Without rows the result
    is empty.
    """
    spark = leaves.sparkSession
    checkpoint_dir(spark)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    rows = leaves.select(F.col(id_col).alias("_id"), key.alias("tree"), F.col("leaf").alias("digest"), "changed").checkpoint()
    schema = T.StructType(
        [leaves.schema[id_col], *T._parse_datatype_string("leaf string, subroot string, root string, proof_sha256 string, copied array<string>, folded_root string, verified boolean").fields]
    )
    placed = numbered(rows, "tree", ["_id", "digest", "changed"])
    of_sources = tiers(placed, levels)
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    subroots = of_sources[-1].select(F.col("tree").alias("source"), "digest", F.lit(_ALL).alias("tree")).checkpoint()
    # The order of sources is that of their keys.
    tops = numbered(subroots, "tree", ["source"]).checkpoint()
    of_all = tiers(tops, levels)
    root = of_all[-1].first()["digest"]
    start = spark.createDataFrame([(_ALL, [])], f"tree string, path {_PATH}")
    to_root = _down(of_all[0], _block_paths(of_all[1:], start, levels), levels).select("pos", "path")
    sources = tops.join(to_root, "pos").select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "path").checkpoint()
    # A source of one leaf has no tier of its own above; its only block is that leaf.
    above = _block_paths(of_sources[1:], sources.select("tree", "path"), levels).join(sources.select("tree", "subroot"), "tree")

    def versions(key: tuple, group: pa.Table, given: pa.Table) -> pa.Table:
        group, top, height = _tree_of(group, levels)
        digests = group["digest"].to_pylist()
        rest = [(p["place"], p["siblings"]) for p in given["path"][0].as_py()]
        tail = "".join(s for _, s in rest)
        proofs, copied = [], []
        for pos, leaf, changed in zip(group["pos"].to_pylist(), digests, group["changed"].to_pylist()):
            turns = _turns(pos % FAN**levels, height)
            proofs.append(_sha("".join(s for _, s in path_of(top, turns)) + tail))
            new = [n.digest for n in replaced(top, turns, changed or leaf)]
            copied.append([*new[-2::-1], *continued(new[0], rest)])
        folded = [c[-1] if c else changed or leaf for c, changed, leaf in zip(copied, group["changed"].to_pylist(), digests)]
        n = len(digests)
        return pa.table(
            {
                "_id": group["_id"], "leaf": digests, "subroot": [given["subroot"][0].as_py()] * n, "root": [root] * n, "proof_sha256": proofs,
                "copied": pa.array(copied, pa.list_(pa.string())), "folded_root": folded, "verified": [f == root for f in folded],
            }
        )

    out = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), *schema.fields[1:]])
    made = _blocks(placed, levels).cogroup(above.groupBy("tree", "block")).applyInArrow(versions, out)
    return made.withColumnRenamed("_id", id_col)


def tampered(docs: DataFrame, where: Column, fields: Sequence[str] = FIELDS, text_col: str = "text") -> DataFrame:
    """Rows for ``manifest``: the columns named by ``fields``, their ``leaf``, and ``changed``, the leaf of the row with
    its text in small letters, for rows ``where``. Other columns are left out."""
    plain = digest_of([F.col(f) for f in fields])
    small = digest_of([lowered(F.col(f)) if f == text_col else F.col(f) for f in fields])
    return docs.select(*[F.col(f) for f in fields if f != text_col], plain.alias("leaf"), F.when(where, small).alias("changed"))
