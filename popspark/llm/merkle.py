"""Merkle dataset manifest: a tree of digests for each source, and one over the sources' roots.

Each tree is cut into blocks of a few levels.  A block lies in one binary value in van Emde Boas
order: a subtree is split at half its height into a top and the subtrees below it, each stored
together and split in the same way, so the nodes on a way to the root share whatever unit is read.
Where a node lies is arithmetic on its depth and number; nodes that a last run lacks take no place.
The roots of blocks are the leaves of the next tier of blocks, until a tree is down to one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

FAN = 16
LEVELS = 4  # of nodes in a block, so FAN ** 3 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
FEW = 2000  # rows of a few kilobytes that are sent to every task

BLOCK = "tree long, size long, block long, n int, levels int, nodes binary, root binary, ids array<long>, claimed array<binary>"


class Manifest(NamedTuple):
    """Blocks of the sources' trees by tier, those of the tree over the sources, and which tree is whose."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame  # tree, source, place (in the order of the sources)
    levels: int


def width(n, up: int):
    """Nodes that stand ``up`` levels above ``n`` leaves."""
    return -(-n // FAN**up)


def nodes(levels: int, n: int) -> int:
    """Nodes of a tree of ``levels`` over ``n`` leaves."""
    return sum(width(n, up) for up in range(levels))


def height(n: int) -> int:
    """Levels of a tree that ends as soon as one node is left."""
    levels = 1
    while width(n, levels - 1) > 1:
        levels += 1
    return levels


def address(levels: int, n: int, depth: int, i: np.ndarray) -> np.ndarray:
    """Where the nodes numbered ``i`` at ``depth`` (the root is at 0) lie in the block.

    The top has half the levels; behind it the trees below lie in order, all full but the last.
    """
    if levels == 1:
        return np.zeros_like(i)
    top = levels // 2
    bottom = levels - top
    if depth < top:
        return address(top, width(n, bottom), depth, i)
    tree, at = np.divmod(i, FAN ** (depth - top))
    full, last = FAN ** (bottom - 1), width(n, bottom - 1) - 1
    inside = np.where(tree < last, address(bottom, full, depth - top, at), address(bottom, n - last * full, depth - top, at))
    return nodes(top, width(n, bottom)) + tree * nodes(bottom, full) + inside


def level(store: np.ndarray, levels: int, n: int, depth: int) -> np.ndarray:
    """The digests at ``depth``, in order."""
    return store[address(levels, n, depth, np.arange(width(n, levels - 1 - depth)))]


def parents(digests: np.ndarray) -> np.ndarray:
    """The digests of runs of FAN digests, which are hashed as hex text."""
    text, run = digests.tobytes().hex().encode(), FAN * DIGEST * 2
    joined = b"".join(hashlib.sha256(text[k : k + run]).digest() for k in range(0, len(text), run))
    return np.frombuffer(joined, np.uint8).reshape(-1, DIGEST)


def build(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The block over the leaves' digests."""
    n = len(leaves)
    store = np.empty((nodes(levels, n), DIGEST), np.uint8)
    below = leaves
    store[address(levels, n, levels - 1, np.arange(n))] = leaves
    for depth in range(levels - 2, -1, -1):
        below = parents(below)
        store[address(levels, n, depth, np.arange(len(below)))] = below
    return store


def siblings(store: np.ndarray, levels: int, n: int) -> list[tuple[bytes, int]]:
    """From the leaves' level up to the root's children: all digests of the level as hex text, and how many they are."""
    found = [level(store, levels, n, depth) for depth in range(levels - 1, 0, -1)]
    return [(x.tobytes().hex().encode(), len(x)) for x in found]


def way(rows: list[tuple[bytes, int]], i: int) -> Iterator[tuple[bytes, bytes]]:
    """For leaf ``i``, level by level: its run's digests before and after its own."""
    size = DIGEST * 2
    for text, many in rows:
        start = i - i % FAN
        yield text[start * size : i * size], text[(i + 1) * size : min(start + FAN, many) * size]
        i //= FAN


def packed(steps) -> bytes:
    """The steps of a way as one value: how many digests stand before and after, then these."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex((a + b).decode()) for a, b in steps)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(path):
        a, b = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + (a + b) * DIGEST].hex().encode()
        out.append((text[: a * 64], text[a * 64 :]))
        at += 2 + (a + b) * DIGEST
    return out


def fold(digest: bytes, steps) -> bytes:
    """The root's hex text that a leaf's hex text and its way give."""
    for before, after in steps:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode()
    return digest


def leaf(*values: Column) -> Column:
    """The digest of a row's values: ``-`` for null, else the bytes' number, a colon and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _grouped(rows: DataFrame, levels: int) -> DataFrame:
    """Blocks of (tree, size, place, leaf, id, claimed); ``size`` is the number of the tree's nodes in this tier."""
    capacity = FAN ** (levels - 1)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        column = lambda name: table.column(name)
        n, size = table.num_rows, column("size")[0].as_py()
        leaves = np.frombuffer(b"".join(column("leaf").to_pylist()), np.uint8).reshape(-1, DIGEST)
        high = levels if size > capacity else height(n)
        store = build(leaves, high)
        root = level(store, high, n, 0).tobytes()
        row = [column("tree")[0].as_py(), size, column("block")[0].as_py(), n, high, store.tobytes(), root, column("id").to_pylist(), column("claimed").to_pylist()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    rows = rows.select("tree", "size", "place", "leaf", "id", "claimed", F.floor(F.col("place") / capacity).cast("long").alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(make, BLOCK)


def _tiers(rows: DataFrame, levels: int) -> list[DataFrame]:
    """All tiers of blocks over the rows; a tier has a row for each block of the tier below in trees of several blocks."""
    capacity, tiers = FAN ** (levels - 1), [saved(_grouped(rows, levels))]
    most = tiers[0].agg(F.max("size")).first()[0] or 0
    while most > capacity:
        up = tiers[-1].filter(F.col("size") > capacity)
        up = up.select("tree", F.ceil(F.col("size") / capacity).cast("long").alias("size"), F.col("block").alias("place"), F.col("root").alias("leaf"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claimed"))
        tiers.append(saved(_grouped(up, levels)))
        most = -(-most // capacity)
    return tiers


def _roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    last = F.col("size") <= FAN ** (levels - 1)
    return reduce(DataFrame.unionByName, [t.filter(last).select("tree", "root") for t in tiers])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", handed_in: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The blocks of the trees over all rows of ``docs``; a leaf is the digest of the row's ``fields``.

    Leaves of a source ascend by id (null first), those of equal ids by digest; sources ascend bytewise,
    null first.  ``handed_in`` gives other values for some fields, whose digests are kept beside the
    leaves where they differ, for ``audit``.  Nulls in any field are values; repeated rows are leaves
    each; an empty table has no blocks; other columns play no part.

    Leaves are sorted by ranges, so a source of any size is dealt out; a place within a source is the
    place in its range plus the ranges before.  A task holds one block.
    """
    values = [F.col(f) for f in fields]
    own = leaf(*values)
    other = leaf(*((handed_in or {}).get(f, F.col(f)) for f in fields))
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(c) for f, c in (handed_in or {}).items()], F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.unhex(own).alias("leaf"), F.when(~same, F.unhex(other)).alias("claimed"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.col(c).asc_nulls_first() for c in ("source", "id", "leaf", "tie")]
    rows = saved(saved(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    parts = saved(rows.groupBy(F.shiftright("at", 33).alias("part"), "source").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    whole = Window.partitionBy("source")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = saved(parts.select("part", F.col("source").alias("of"), "first", before.alias("before"), F.min("first").over(whole).alias("tree"), F.sum("n").over(whole).alias("size")))
    few = starts.count() <= FEW
    met = (F.shiftright("at", 33) == F.col("part")) & F.col("source").eqNullSafe(F.col("of"))
    placed = rows.join(F.broadcast(starts) if few else starts, met)
    placed = placed.select("tree", "size", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "leaf", "id", "claimed")
    tiers = _tiers(placed, levels)

    # A source's tree is named by where its first leaf lies, which is in the order of the sources.
    trees = starts.groupBy("tree").agg(F.first("of").alias("source")).withColumn("part", F.shiftright("tree", 33))
    first = trees.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    first = first.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    trees = saved(trees.join(first, "part").select("tree", "source", (F.col("before") + number).alias("place")))
    top = trees.join(_roots(tiers, levels), "tree").select(F.lit(0).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("size"), "place", F.col("root").alias("leaf"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claimed"))
    return Manifest(tiers, _tiers(top, levels), trees, levels)


def _below(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(tree, place, path, subroot) of each leaf of the blocks: its way in the block and the block's own."""
    capacity = FAN ** (levels - 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                rows = siblings(np.frombuffer(b["nodes"], np.uint8).reshape(-1, DIGEST), b["levels"], b["n"])
                paths = [packed(way(rows, i)) + b["path"] for i in range(b["n"])]
                places = np.arange(b["n"]) + b["block"] * capacity
                cols = [pa.array(np.full(b["n"], b["tree"])), pa.array(places), pa.array(paths, pa.binary()), pa.array([b["subroot"]] * b["n"], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "place", "path", "subroot"])

    met = _met(blocks.select("tree", "block", "n", "levels", "nodes"), above)
    return saved(met.mapInArrow(walk, "tree long, place long, path binary, subroot binary"))


def _met(blocks: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select("tree", F.col("place").alias("block"), "path", "subroot")
    return blocks.join(F.broadcast(above) if above.count() <= FEW else above, ["tree", "block"])


def paths(m: Manifest) -> DataFrame:
    """(tree, block, path, subroot): the way from the root of each block of the first tier to that of the sources."""
    spark = m.trees.sparkSession
    above = spark.createDataFrame([(0, 0, b"", None)], "tree long, place long, path binary, subroot binary")
    for tier in reversed(m.top):
        above = _below(tier, above, m.levels)
    own = m.trees.join(above.select("place", "path"), "place").join(_roots(m.tiers, m.levels), "tree")
    own = saved(own.select("tree", F.lit(0).cast("long").alias("place"), "path", F.col("root").alias("subroot")))
    above = None
    for tier in reversed(m.tiers[1:]):
        ends = tier.filter(F.col("size") <= FAN ** (m.levels - 1)).select("tree").join(own, "tree")
        above = _below(tier, ends if above is None else above.unionByName(ends), m.levels)
    ends = m.tiers[0].filter(F.col("size") <= FAN ** (m.levels - 1)).select("tree").join(own, "tree")
    ends = ends.select("tree", "place", "path", "subroot")
    return saved(ends if above is None else above.unionByName(ends))


def audit(m: Manifest) -> DataFrame:
    """Every leaf held against the root by its way: doc_id, leaf, subroot, root, proof_sha256 (of all
    siblings), folded_root (from the value handed in, where it differs, else from the leaf) and verified.
    """
    top = m.top[-1].select("root").first()
    root = top[0].hex() if top else ""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                n = b["n"]
                store = np.frombuffer(b["nodes"], np.uint8).reshape(-1, DIGEST)
                leaves = level(store, b["levels"], n, b["levels"] - 1).tobytes().hex()
                rows, above = siblings(store, b["levels"], n), unpacked(b["path"])
                shared = b"".join(x + y for x, y in above)
                out = []
                for i, (doc, claimed) in enumerate(zip(b["ids"], b["claimed"], strict=True)):
                    steps = list(way(rows, i))
                    own = leaves[i * 64 : i * 64 + 64]
                    proof = hashlib.sha256(b"".join(x + y for x, y in steps) + shared).hexdigest()
                    folded = fold(fold(claimed.hex().encode() if claimed is not None else own.encode(), steps), above).decode()
                    out.append((doc, own, b["subroot"].hex(), root, proof, folded, folded == root))
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    way_up = paths(m).withColumnRenamed("place", "block")
    met = m.tiers[0].join(F.broadcast(way_up) if way_up.count() <= FEW else way_up, ["tree", "block"])
    return met.mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
